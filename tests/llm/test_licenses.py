from __future__ import annotations

import math
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from orderdesk.llm import licenses


def brute(files, min_cosine=licenses.MIN_COSINE):
    """Best template over all lines and whole texts by dense cosine, then the nearest ancestor."""
    vocabulary = {t for _, body in licenses.TEMPLATES for t in licenses.terms_of(body)}
    n = len(files)
    df = {t: sum(t in licenses.terms_of(x or "") for _, x in files) for t in vocabulary}
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}

    def best(unit):
        x = {t: k * idf.get(t, 1.0) for t, k in licenses.terms_of(unit).items()}
        out = []
        for name, body in licenses.TEMPLATES:
            y = {t: k * idf[t] for t, k in licenses.terms_of(body).items()}
            dot = sum(w * y.get(t, 0) for t, w in x.items())
            if dot:
                out.append((-round(dot / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values())), 9), name))
        return min(out) if out and -min(out)[0] >= min_cosine else None
    own, directory = {}, {}
    for path, text in files:
        found = [b for b in map(best, [text or "", *(text or "").split("\n")]) if b]
        own[path] = min(found) if found else None
        whole = best(text or "")
        if whole and path is not None:
            d = path.rpartition("/")[0]
            directory[d] = min(directory.get(d, (1,)), (whole[0], whole[1], path))
    out = {}
    for path, _ in files:
        if own[path]:
            out[path] = (own[path][1], None)
            continue
        d, seen = path.rpartition("/")[0], None
        while True:
            if d in directory:
                seen = (directory[d][1], d)
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        out[path] = seen or (None, None)
    return out


def test_matches_dense_cosine_and_inheritance(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "version", "work", "zu", "is", "software", "thor", "stone", "public"])
    files = []
    for i in range(160):
        path = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        path = f"{path}/f{i}" if path else f"f{i}"
        lines = [" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.3:
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            lines.insert(rng.randint(0, len(lines)), " ".join(w for w in notice if rng.random() < 0.93))
        files.append((path, "\n".join(lines)))
    df = spark.createDataFrame(files, "path string, text string").repartition(3)
    got = {r.path: (r["__licence"], r["__from"]) for r in licenses.licensed(df).collect()}
    assert got == brute(files)
    assert sum(v[0] is not None for v in got.values()) > 40 and sum(v[1] is not None for v in got.values()) > 10


def test_heavy_terms_keep_every_match():
    idf = {t: 1 + len(t) / 3 for _, body in licenses.TEMPLATES for t in licenses.terms_of(body)}
    weights = licenses.template_weights(idf, licenses.TEMPLATES)
    heavy = set(licenses.heavy_terms(weights, 0.7))
    for number in range(len(licenses.TEMPLATES)):
        rest = sum(w * w for _, n, t, w in weights if n == number and t not in heavy)
        assert math.sqrt(rest) < 0.7
        assert sum(w * w for _, n, _, w in weights if n == number) == pytest.approx(1)


def test_odd_rows(spark, odd, none):
    df = odd.withColumn("path", F.when(F.col("doc_id") > 2, F.concat(F.lit("a//b/"), F.col("doc_id"))))
    out = licenses.licensed(df)
    assert out.count() == odd.count() and {r["__licence"] for r in out.collect()} == {None}
    assert licenses.licensed(none.withColumn("path", F.lit("a/b"))).count() == 0
    one = spark.createDataFrame([("LICENSE", "Released under the MIT License."), ("x/y/z.c", "int main"), ("x/y/z.c", "int main"), (None, "a")],
                                "path string, text string")
    assert sorted((r.path or "", r["__licence"] or "", r["__from"]) for r in licenses.licensed(one).collect()) == [
        ("", "", None), ("LICENSE", "MIT", None), ("x/y/z.c", "MIT", ""), ("x/y/z.c", "MIT", "")]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(spark, mark):
    long = [(name, body) for name, body in licenses.TEMPLATES if len(body) > 100]
    files = [(f"d{i}/x.c", name, "\n".join([
        f"{mark}Thor and stone zu {i}", mark.rstrip(), *[mark + x for x in textwrap.wrap(body, 50)], mark.rstrip(), "int main() {", "  return 0;", "}"]))
        for i, (name, body) in enumerate(long)]
    files += [(f"p{i}/y.c", None, f"int f{i}() {{\n  return the_sum_of(all, any);\n}}\n# a copy of the file") for i in range(200)]
    df = spark.createDataFrame([(p, t) for p, _, t in files], "path string, text string").repartition(3)
    got = {r.path: (r["__licence"], r["__cosine"]) for r in licenses.licensed(df).collect()}
    assert {p: got[p][0] for p, _, _ in files} == {p: name for p, name, _ in files}
    assert all(got[p][1] > 0.99 for p, name, _ in files if name)


MIT = """The MIT License (MIT)

Copyright (c) 2020 Thor. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licence_texts_pass_on(spark):
    body = "\n".join(f"the clause {i} of a long text and any other word {i * 7}" for i in range(300))
    opening = {name: "\n".join([*textwrap.wrap(block, 60), "", body]) for name, block, n in licenses.TEXTS if not n}
    texts = {("MIT.txt", "MIT"): MIT, ("LICENSE", "BSD-3-Clause"): "\n".join([
        "Copyright (c) Thor.", "All rights reserved.", "", *textwrap.wrap(dict(licenses.TEMPLATES[2:3])["BSD-3-Clause"] + ":", 60), body])}
    texts |= {(f"{i}.text", name): t for i, (name, t) in enumerate(opening.items())}
    files, want = [(f"p{i}/y.c", f"int f{i}() {{}}") for i in range(200)], {}
    for i, ((file, name), text) in enumerate(texts.items()):
        files += [(f"d{i}/{file}", text), (f"d{i}/src/a.c", "int main() {}")]
        want[f"d{i}/src/a.c"] = (name, f"d{i}")
    files += [("h/x.c", MIT + "int x(int y);\n" * 90), ("h/y.c", "int y;")]  # a header is no licence file
    want["h/x.c"], want["h/y.c"] = ("MIT", None), (None, None)
    df = spark.createDataFrame(files, "path string, text string").repartition(3)
    got = {r.path: (r["__licence"], r["__from"]) for r in licenses.licensed(df).collect()}
    assert {p: got[p] for p in want} == want


@pytest.mark.parametrize("path, named", [("LICENSE", True), ("a/LICENCE.md", True), ("a/COPYING.LESSER", True), ("LICENSE-APACHE-2.0.txt", True),
                                         ("a/MIT-LICENSE", True), ("license.py", False), ("a/license_check.py", False), ("LICENSE/a.c", False)])
def test_names_of_licence_files(spark, path, named):
    assert spark.range(1).select(F.rlike(F.lit(path), F.lit(licenses.NAMED)).alias("x")).first()["x"] is named
