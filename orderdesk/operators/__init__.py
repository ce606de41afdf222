"""Relational building blocks: size-checked broadcasts, per-booking item aggregates, one-pass stats, the bulk workflow jobs, audits and skew-safe joins."""
