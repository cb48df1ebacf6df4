"""Secret scans by grammar inference: automata of labelled credentials score every candidate by its format."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.session import ship

#: Fixed patterns of the base kinds, in their listed order, and the characters that the kind needs (of group 2, if any).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16),
)
KINDS = (*(k for k, _, _ in BASE), "format")
#: What a plain word lacks: digits, or a capital after its first letter with small letters beside it.
_SIGNS = re.compile("[0-9]+|(?<=[a-z])[A-Z]|(?<=[A-Z])[A-Z](?=[a-z])")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
LEAST = 12  # characters of a candidate


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, secret) of the base kinds, leftmost and non-overlapping in each kind."""
    out = []
    for order, (kind, pattern, least) in enumerate(BASE):
        if kind == "assign" and ":" not in text and "=" not in text or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            secret = m[2] if kind == "assign" else m[0]
            if len(secret) >= least:
                out.append((m.start(), order, m.end(), secret))
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of credential characters, of 12 characters and more, with a digit or with capitals inside. Words in
    one case have the shape of a word whatever their letters, so formats cannot tell them from text."""
    end = 0
    for m in _SIGNS.finditer(text):
        if m.start() < end:
            continue
        a, b = m.start(), m.end()
        while a > end and text[a - 1] in _RUN:
            a -= 1
        while b < len(text) and text[b] in _RUN:
            b += 1
        end = b
        if b - a >= LEAST:
            yield a, b


def shape(secret: str) -> str:
    """Classes of characters: digits 0, a-f a, other small letters z, capitals A, marks as they are."""
    return "".join("0" if "0" <= c <= "9" else "a" if "a" <= c <= "f" else "z" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in secret)


class Automaton:
    """A probabilistic deterministic automaton by ALERGIA: a prefix tree whose compatible states are merged."""

    def __init__(self, samples: Iterable[str], alpha: float = 0.01) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        for s in sorted(samples):
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n1, n2 = self.total(p), self.total(q)
            if self._differ(self.ends[p], n1, self.ends[q], n2):
                return False
            for c in {**self.count[p], **self.count[q]}:
                if self._differ(self.count[p].get(c, 0), n1, self.count[q].get(c, 0), n2):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = sorted({(q, p, c) for p in red for c, q in self.next[p].items() if q not in red})
            if not blue:
                return
            q, p, c = blue[0]
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)

    def score(self, s: str) -> float:
        """Mean ln probability a symbol (the end counts as one); minus infinity where the format has no such path."""
        at, total = 0, 0.0
        for c in s:
            n = self.count[at].get(c, 0)
            if not n:
                return -math.inf
            total += math.log(n / self.total(at))
            at = self.next[at][c]
        if not self.ends[at]:
            return -math.inf
        return (total + math.log(self.ends[at] / self.total(at))) / (len(s) + 1)


class Formats:
    """Automata of the labelled kinds, each with the least score of its own labelled credentials' ``quantile``."""

    def __init__(self, labelled: Iterable[tuple[str, str]], quantile: float = 0.02) -> None:
        by: dict[str, list[str]] = {}
        for kind, secret in labelled:
            by.setdefault(kind, []).append(shape(secret))
        self.models = {}
        for kind in sorted(by):
            model = Automaton(by[kind])
            scores = sorted(model.score(s) for s in by[kind])
            self.models[kind] = (model, scores[int(quantile * len(scores))])
        self.known: dict[str, bool] = {}

    def likely(self, secret: str) -> bool:
        s = shape(secret)
        if s not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[s] = any(m.score(s) >= least for m, least in self.models.values())
        return self.known[s]


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(BASE[o][0], s) for t in b.column(0).to_pylist() if t for _, o, _, s in base_spans(t)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["kind", "secret"])


def labelled_credentials(docs: DataFrame, text_col: str = "text", per_kind: int = 500) -> list[tuple[str, str]]:
    """Training rows: at most ``per_kind`` different base secrets of each kind. Secrets fall into ``per_kind`` classes by
    hash, and the one of the smallest hash in each is taken, by an aggregation that is partial before the shuffle."""
    ship(docs.sparkSession)
    every = docs.select(F.col(text_col).alias("text")).mapInArrow(_labels, "kind string, secret string")
    h = F.xxhash64("secret")
    chosen = every.groupBy("kind", F.pmod(h, F.lit(per_kind)).alias("_class")).agg(F.min(F.struct(h.alias("h"), "secret"))["secret"].alias("secret"))
    return sorted((r["kind"], r["secret"]) for r in chosen.select("kind", "secret").collect())


def scan(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_format, base and spans.

    ``base`` and ``spans`` list kind:start:end (code points, end exclusive) by start, then kind, comma-joined: the base
    spans always stay; ``spans`` adds, as kind format, candidates that overlap none and that an automaton finds likely.
    Every text is read whole. Nulls: a null text is empty; a null id stays null. Repeated rows get equal rows. Extra
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(formats)  # automata of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            count = np.zeros((4, b.num_rows), np.int64)
            base, every = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = base_spans(t) if t else []
                more = []
                if t:
                    for a, e in candidates(t):
                        if not any(x[0] < e and a < x[2] for x in own) and known.likely(t[a:e]):
                            more.append((a, 3, e, ""))
                for x in (*own, *more):
                    count[x[1], i] += 1
                base.append(",".join(f"{KINDS[o]}:{s}:{e}" for s, o, e, _ in own))
                every.append(",".join(f"{KINDS[o]}:{s}:{e}" for s, o, e, _ in sorted([*own, *more])))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, count), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base string, spans string")
