"""A bidirectional gated recurrent network over bytes, in numpy.

One recurrent step reads ``stride`` bytes through one embedding table per
offset; a forward and a backward layer run over a window of bytes. Every byte
position gets class logits from both states of its step and from its own
byte. Training is backpropagation through time with Adam.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]

HIDDEN = 16
STRIDE = 4
WINDOW = 256


def init_params(classes: int, hidden: int = HIDDEN, stride: int = STRIDE, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    params = {"byte": np.zeros((256, classes)), "bias": np.zeros(classes)}
    for d in ("f", "b"):
        params[f"embed_{d}"] = rng.normal(0, 0.3 / np.sqrt(stride), (stride, 256, 3 * hidden))
        params[f"gate_{d}"] = np.zeros(3 * hidden)
        params[f"state_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        params[f"out_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, classes))
    return {k: v.astype(np.float32) for k, v in params.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _inputs(table: np.ndarray, bias: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """Gate inputs of one step: ``bytes_`` is (stride, lanes)."""
    x = table[0].take(bytes_[0], axis=0)
    for k in range(1, len(bytes_)):
        x += table[k].take(bytes_[k], axis=0)
    x += bias
    return x


def _run(p: Params, d: str, steps: np.ndarray, tape: list | None) -> np.ndarray:
    """Class logits (classes, steps, lanes) of one direction; ``steps`` is (steps, stride, lanes).

    With ``tape`` the states and gates of every step are appended to it.
    """
    table, bias, state, out = p[f"embed_{d}"], p[f"gate_{d}"], p[f"state_{d}"], p[f"out_{d}"]
    n_steps, _, lanes = steps.shape
    hidden = state.shape[0]
    logits = np.empty((out.shape[1], n_steps, lanes), np.float32)
    h = np.zeros((lanes, hidden), np.float32)
    for t in range(n_steps) if d == "f" else range(n_steps - 1, -1, -1):
        x = _inputs(table, bias, steps[t])
        u = h @ state
        zr = x[:, :2 * hidden] + u[:, :2 * hidden]
        zr = _sigmoid(zr)
        z, r, hn = zr[:, :hidden], zr[:, hidden:], u[:, 2 * hidden:]
        n = np.tanh(x[:, 2 * hidden:] + r * hn)
        new = n + z * (h - n)
        if tape is not None:
            tape.append((t, h, z, r, hn, n, new))
        h = new
        logits[:, t] = (h @ out).T
    return logits


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts cut into windows: (windows, window) bytes, valid lengths, text of each window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // window)
    owner = np.repeat(np.arange(len(texts)), counts)
    data = np.frombuffer(b"".join(t + bytes(-len(t) % window) for t in texts), np.uint8).reshape(-1, window)
    lengths = np.full(len(owner), window, np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    lengths[last] = sizes[counts > 0] - (counts[counts > 0] - 1) * window
    return data, lengths, owner


def _steps(data: np.ndarray, stride: int) -> np.ndarray:
    """(lanes, window) -> (steps, stride, lanes)."""
    lanes, window = data.shape
    return np.ascontiguousarray(data.reshape(lanes, window // stride, stride).transpose(1, 2, 0))


def position_sums(p: Params, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(lanes, classes): class probabilities of every valid byte position, summed per window."""
    stride = p["embed_f"].shape[0]
    steps = _steps(data, stride)
    logits = _run(p, "f", steps, None)
    logits += _run(p, "b", steps, None)
    logits += p["bias"][:, None, None]
    logits -= logits.max(axis=0)
    state = np.exp(logits, out=logits)
    own = np.exp(p["byte"] - p["byte"].max(axis=1, keepdims=True)).T.copy()
    totals = np.zeros((len(state), data.shape[0]), np.float64)
    partial = bool((lengths < data.shape[1]).any())
    for k in range(stride):
        joint = own[:, steps[:, k]]
        joint *= state
        whole = joint.sum(axis=0)
        np.divide(1.0, whole, out=whole)
        if partial:
            whole *= (np.arange(steps.shape[0])[:, None] * stride + k) < lengths[None, :]
        joint *= whole
        totals += joint.sum(axis=1)
    return totals.T


def pooled(p: Params, texts: list[bytes], window: int = WINDOW, lanes: int = 2048) -> np.ndarray:
    """(texts, classes): mean class probability over all byte positions of each text (zeros if empty)."""
    classes = len(p["bias"])
    sums = np.zeros((len(texts), classes))
    start = 0
    while start < len(texts):  # texts in groups of a bounded number of bytes, long ones alone
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= lanes * window * 4):
            size += len(texts[end])
            end += 1
        data, lengths, owner = windows_of(texts[start:end], window)
        for at in range(0, len(data), lanes):
            part = position_sums(p, data[at:at + lanes], lengths[at:at + lanes])
            np.add.at(sums, start + owner[at:at + lanes], part)
        start = end
    sizes = np.array([max(1, len(t)) for t in texts], np.float64)
    return sums / sizes[:, None]


def _table_gradient(rows: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``rows`` per value of ``index``."""
    order = np.argsort(index, kind="stable")
    values, starts = np.unique(index[order], return_index=True)
    grad = np.zeros((size, rows.shape[1]), np.float32)
    grad[values] = np.add.reduceat(rows[order], starts, axis=0)
    return grad


def gradients(p: Params, data: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over the valid positions and its gradients, by backpropagation through time."""
    stride, hidden = p["embed_f"].shape[0], p["state_f"].shape[0]
    steps = _steps(data, stride)
    n_steps, _, lanes = steps.shape
    tapes: dict[str, list] = {"f": [], "b": []}
    logits = _run(p, "f", steps, tapes["f"]) + _run(p, "b", steps, tapes["b"]) + p["bias"][:, None, None]
    full = logits.transpose(1, 2, 0)[:, None] + p["byte"][steps]  # steps, stride, lanes, classes
    full -= full.max(axis=-1, keepdims=True)
    prob = np.exp(full)
    prob /= prob.sum(axis=-1, keepdims=True)
    place = np.arange(n_steps)[:, None] * stride + np.arange(stride)[None, :]
    valid = (place[:, :, None] < lengths[None, None, :]).astype(np.float32)
    count = valid.sum()
    hit = np.take_along_axis(prob, np.broadcast_to(target[None, None, :, None], prob.shape[:3] + (1,)), -1)[..., 0]
    loss = float(-(np.log(hit + 1e-12) * valid).sum() / count)
    prob[..., np.arange(lanes), target] -= 1
    prob *= valid[..., None] / count
    grads = {"byte": _table_gradient(prob.reshape(-1, prob.shape[-1]), steps.reshape(-1), 256),
             "bias": prob.sum(axis=(0, 1, 2))}
    dlogits = prob.sum(axis=1)  # steps, lanes, classes
    for d, tape in tapes.items():
        out, state = p[f"out_{d}"], p[f"state_{d}"]
        dout, dstate = np.zeros_like(out), np.zeros_like(state)
        dx = np.empty((n_steps, lanes, 3 * hidden), np.float32)
        carry = np.zeros((lanes, hidden), np.float32)
        for t, h, z, r, hn, n, new in reversed(tape):
            dout += new.T @ dlogits[t]
            dh = carry + dlogits[t] @ out.T
            dn = dh * (1 - z) * (1 - n * n)
            dx[t, :, :hidden] = dh * (h - n) * z * (1 - z)
            dx[t, :, hidden:2 * hidden] = dn * hn * r * (1 - r)
            dx[t, :, 2 * hidden:] = dn
            dgate = dx[t].copy()
            dgate[:, 2 * hidden:] *= r
            dstate += h.T @ dgate
            carry = dh * z + dgate @ state.T
        flat = dx.reshape(-1, 3 * hidden)
        grads[f"out_{d}"], grads[f"state_{d}"], grads[f"gate_{d}"] = dout, dstate, flat.sum(axis=0)
        grads[f"embed_{d}"] = np.stack([_table_gradient(flat, steps[:, k].reshape(-1), 256) for k in range(stride)])
    return loss, grads


def train(data: np.ndarray, lengths: np.ndarray, target: np.ndarray, classes: int, epochs: int = 4,
          batch: int = 128, rate: float = 0.01, seed: int = 7) -> Params:
    """Adam over shuffled minibatches of windows; the same input gives the same parameters."""
    p = init_params(classes, seed=seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step, total = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            _, grads = gradients(p, data[pick], lengths[pick], target[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= (lr * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p
