"""Plain versions of the pipeline operators, for small inputs."""

import hashlib


def substring_dedup(rows, length=100):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha256)} of rows (doc_id, text), ids not repeated."""
    first = {}
    ordered = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    raw = {r: (r[1] or "").encode() for r in ordered}
    for row in ordered:
        data = raw[row]
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], (row, i))
    out = {}
    for row in ordered:
        data = raw[row]
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] != (row, i):
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[row] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
