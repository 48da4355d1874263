"""Secret scans with one combined automaton for all rules (:mod:`reelcat.llm.automaton`).

The forward pass finds where matches end; for these few places the rule's regex, run
backwards, finds the start (not before the same rule's previous match).

Defined cases: a null text is empty and has no spans; offsets are code points, the
end exclusive; repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.llm.automaton import Automaton, Rule, Threads
from reelcat.llm.common import column, per_worker, raw

_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: fixed values: the three base kinds, then the further ones, in the order of output
BASE = (
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 12, _HEAD),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.forward = Automaton(list(rules))
        self.backward = [Threads(r.regex, reverse=True) for r in rules]
        self.heads = [Threads(r.head) if r.head else None for r in rules]

    def spans(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text in bytes, by start, then by rule."""
        stop = bytes([int(self.forward.resets[0])])
        whole = stop.join([*texts, b""])
        data = np.frombuffer(whole, np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        out: list[list] = [[] for _ in texts]
        at, said = self.forward.scan(data)
        docs = np.searchsorted(begins, at, side="right") - 1
        done: dict[tuple[int, int], int] = {}
        for end, bits, d in zip(at.tolist(), said.tolist(), docs.tolist()):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1:
                    base = int(begins[d])
                    start = self.backward[k].farthest(whole, end, max(base, done.get((d, k), 0)))
                    done[d, k] = end
                    value = self.heads[k].farthest(whole, start, end) if self.heads[k] else start
                    if end - value >= rule.least:
                        out[d].append((start - base, k, end - base))
        return [[(self.rules[k].kind, s, e) for s, k, e in sorted(x)] for x in out]


def _points(text: bytes, spans: list) -> list[dict]:
    if spans and not text.isascii():
        points = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])
        spans = [(k, int(points[s]), int(points[e])) for k, s, e in spans]
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans (array of kind, start, end; by start, then by rule) for every row."""
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(("secrets", rules), lambda: Scanner(rules))
        for b in batches:
            texts = raw(b)
            found = [_points(t, s) for t, s in zip(texts, scanner.spans(texts))]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(found, one)], names=["doc_id", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")
