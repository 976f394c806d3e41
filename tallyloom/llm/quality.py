"""Quality rules as a short-circuit cascade (operator 10).

Each rule is a pure function of a whole text. A sample tells what each rule costs and how much it
rejects of what the rules before it leave; rules then run in order of rejection per cost, each only
on the texts that all earlier rules have kept. The order changes the work, never the verdict. The
base counts are results of their own and made for every text; rules that only compare them cost
next to nothing and come first by their cost.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import Chunk, PrefixHash, chunks, mix, words

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Limits of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Limits of the cascade's rules.
LIMITS = {
    "symbol_percent": 10,
    "duplicate_line_percent": 50,
    "repeat_word_percent": 30,
    "min_mean_word": 2.0,
    "max_mean_word": 14.0,
    "max_word": 1000,
    "upper_percent": 40,
    "min_alpha_word_percent": 70,
    "digit_percent": 20,
    "exclamation_percent": 15,
}


@dataclass
class Texts:
    """A chunk with its words, found once."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    base: dict[str, np.ndarray]

    def pick(self, rows: np.ndarray) -> Texts:
        """Some of the texts, in ascending order; their words are not looked for again."""
        if len(rows) == self.chunk.n:
            return self
        c = self.chunk.pick(rows)
        place = np.full(self.chunk.n, -1)
        place[rows] = np.arange(len(rows))
        kept = place[self.owner] >= 0
        owner = place[self.owner[kept]]
        shift = (c.offs[:-1] - self.chunk.offs[rows])[owner]
        return Texts(c, self.starts[kept] + shift, self.ends[kept] + shift, owner, self.n_words[rows], self.word_chars[rows], {k: v[rows] for k, v in self.base.items()})


def _per_doc(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def _lut(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


_SYMBOL = _lut(SYMBOLS.encode())
_UPPER = _lut(bytes(range(65, 91)))
_LOWER = _lut(bytes(range(97, 123)))
_DIGIT = _lut(bytes(range(48, 58)))
_LETTER = _UPPER | _LOWER | np.array([b >= 0xC3 for b in range(256)])  # non-ASCII leads count as letters
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def repeat_words(c: Chunk, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in that text."""
    n = len(starts)
    if n < 3:
        return np.zeros(c.n, np.int64)
    ph = PrefixHash(c.data)
    w = mix(ph.of(starts, ends))
    with np.errstate(over="ignore"):
        key = mix(w[:-2] * np.uint64(3) + mix(w[1:-1] + np.uint64(1)) * np.uint64(5) + mix(w[2:] + np.uint64(2)) * np.uint64(7) + mix(owner[:-2].astype(np.uint64) + np.uint64(99)))
    whole = np.flatnonzero(owner[:-2] == owner[2:])
    key = key[whole]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(k), bool)
    hit[1:] |= same
    hit[:-1] |= same
    windows = whole[order[hit]]
    covered = np.zeros(n, bool)
    for d in range(3):
        covered[windows + d] = True
    return _per_doc(owner[covered], c.n)


def duplicate_lines(c: Chunk, word_starts: np.ndarray) -> np.ndarray:
    """Per text, the lines that hold a word and equal an earlier line of that text."""
    if not len(word_starts):
        return np.zeros(c.n, np.int64)
    breaks = np.flatnonzero(c.data == 10)
    starts = np.unique(np.concatenate([c.offs[:-1], breaks + 1]))
    starts = starts[starts < len(c.data)]
    line_of_word = np.searchsorted(starts, word_starts, "right") - 1
    used = np.unique(line_of_word)
    s = starts[used]
    stop = np.append(starts[1:], len(c.data))[used]
    owner = c.doc_of(s)
    stop = np.minimum(stop, c.offs[owner + 1])
    stop = stop - ((stop > s) & (c.data[np.maximum(stop - 1, 0)] == 10))
    ph = PrefixHash(c.data, 1)
    with np.errstate(over="ignore"):
        key = mix(mix(ph.of(s, stop) + (stop - s).astype(np.uint64)) + mix(owner.astype(np.uint64) + np.uint64(7)))
    _, first = np.unique(key, return_index=True)
    return _per_doc(owner, c.n) - _per_doc(owner[first], c.n)


def measured(c: Chunk) -> Texts:
    """The words and base counts of a chunk's texts."""
    starts, ends, owner = words(c)
    n_words = _per_doc(owner, c.n)
    head = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(_HEAD[c.data], out=head[1:])
    chars = np.bincount(owner, weights=head[ends] - head[starts], minlength=c.n).astype(np.int64)
    base = {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": c.sums(_SYMBOL[c.data]),
        "n_dup_lines": duplicate_lines(c, starts),
        "n_repeat_words": repeat_words(c, starts, ends, owner),
    }
    base["base_failed"] = (n_words < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    return Texts(c, starts, ends, owner, n_words, base["word_chars"], base)


def _percent_over(part: np.ndarray, whole: np.ndarray, percent: float) -> np.ndarray:
    return 100 * part > percent * whole


def rule_symbols(t: Texts) -> np.ndarray:
    return _percent_over(t.base["n_symbols"], t.word_chars, LIMITS["symbol_percent"])


def rule_repeats(t: Texts) -> np.ndarray:
    return _percent_over(t.base["n_repeat_words"], t.n_words, LIMITS["repeat_word_percent"])


def rule_mean_word(t: Texts) -> np.ndarray:
    return (t.word_chars < LIMITS["min_mean_word"] * t.n_words) | (t.word_chars > LIMITS["max_mean_word"] * t.n_words)


def rule_duplicate_lines(t: Texts) -> np.ndarray:
    lines = t.chunk.sums(t.chunk.data == 10) + 1
    return _percent_over(t.base["n_dup_lines"], lines, LIMITS["duplicate_line_percent"])


def rule_longest_word(t: Texts) -> np.ndarray:
    out = np.zeros(t.chunk.n, bool)
    out[t.owner[t.ends - t.starts > LIMITS["max_word"]]] = True
    return out


def rule_upper(t: Texts) -> np.ndarray:
    return _percent_over(t.chunk.sums(_UPPER[t.chunk.data]), t.word_chars, LIMITS["upper_percent"])


def rule_digits(t: Texts) -> np.ndarray:
    return _percent_over(t.chunk.sums(_DIGIT[t.chunk.data]), t.word_chars, LIMITS["digit_percent"])


def rule_exclamations(t: Texts) -> np.ndarray:
    return _percent_over(t.chunk.sums(t.chunk.data == 33), t.n_words, LIMITS["exclamation_percent"])


def rule_alpha_words(t: Texts) -> np.ndarray:
    c = np.zeros(len(t.chunk.data) + 1, np.int64)
    np.cumsum(_LETTER[t.chunk.data], out=c[1:])
    good = _per_doc(t.owner[c[t.ends] > c[t.starts]], t.chunk.n)
    return 100 * good < LIMITS["min_alpha_word_percent"] * t.n_words


#: Each rule tells, per text, whether it rejects.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "symbols": rule_symbols,
    "repeats": rule_repeats,
    "mean_word": rule_mean_word,
    "duplicate_lines": rule_duplicate_lines,
    "longest_word": rule_longest_word,
    "upper": rule_upper,
    "digits": rule_digits,
    "exclamations": rule_exclamations,
    "alpha_words": rule_alpha_words,
}


def cascade(t: Texts, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The verdict per text, and the 1-based place in ``order`` of the rule that rejected it (0: none)."""
    n = t.chunk.n
    rejected_by = np.zeros(n, np.int32)
    alive = np.flatnonzero(~t.base["base_failed"])
    live = t.pick(alive) if len(alive) else None
    for k, name in enumerate(order, 1):
        if not len(alive):
            break
        bad = RULES[name](live)
        if bad.any():
            rejected_by[alive[bad]] = k
            alive = alive[~bad]
            if len(alive):
                live = live.pick(np.flatnonzero(~bad))
    return ~t.base["base_failed"] & (rejected_by == 0), rejected_by


def plan_rules(texts: list[str], rules: dict[str, Callable] | None = None) -> list[dict]:
    """Rules in their order, with cost (seconds a text) and what each rejects of all sampled texts and of those left to it.

    The next rule is the one that rejects most, for its cost, of the texts that the rules before it leave.
    """
    rules = rules or RULES
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [measured(c) for c in chunks(batch, "text")]
    parts = [t.pick(rows) for t in parts if len(rows := np.flatnonzero(~t.base["base_failed"]))]
    n = sum(t.chunk.n for t in parts)
    cost, bad = {}, {}
    for name, f in rules.items():
        began = time.perf_counter()
        bad[name] = np.concatenate([np.zeros(0, bool), *(f(t) for t in parts)])
        cost[name] = max(time.perf_counter() - began, 1e-9) / max(n, 1)
    left, found, waiting = np.ones(n, bool), [], set(rules)
    gain = lambda name: ((bad[name] & left).sum() + 0.5) / (n + 1) / cost[name]
    while waiting:
        name = min(waiting, key=lambda name: (-gain(name), name))
        found.append({"rule": name, "cost_s": cost[name], "rejects": bad[name].sum() / max(n, 1), "rejects_of_rest": (bad[name] & left).sum() / max(left.sum(), 1), "gain": gain(name)})
        left &= ~bad[name]
        waiting.remove(name)
    return found


#: Sampled texts that set the order of the rules; only the order depends on them.
SAMPLE_ROWS = 400


def rule_order(documents: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' order from a bounded sample: at most ``sample_rows`` texts of at most 20,000 characters."""
    rows = documents.where(F.length(text) <= 20_000).select(text).limit(sample_rows).collect()
    return [r["rule"] for r in plan_rules([r[0] for r in rows])] if rows else list(RULES)


def apply_quality(documents: DataFrame, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the base counts, ``base_failed``, ``kept`` and the rule that rejected it.

    Null and empty texts have no words: all counts 0, ``base_failed`` true, ``kept`` false.
    Repeated rows each give a row. Other columns are ignored, whatever their names.
    ``rejected_by`` is null where no rule of the cascade rejected (``base`` where the base rule did).
    """
    order = order or rule_order(documents, text_col)
    names = pa.array(["", *order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                t = measured(c)
                kept, by = cascade(t, order)
                rule = names.take(pa.array(by)).to_pylist()
                rule = ["base" if f else (r or None) for f, r in zip(t.base["base_failed"].tolist(), rule, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, c.n),
                        *(pa.array(t.base[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
                        pa.array(kept),
                        pa.array(rule, pa.string()),
                    ],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    src = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, schema)
