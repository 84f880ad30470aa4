"""Operator 2: language identification of mixed-language text.

A word's script, read from code-point ranges, narrows the languages it can be in to those seen in that
script when learning. Each word gets a log-probability per language from hashed character n-grams,
and a Viterbi pass over the words, which pays a penalty for each change of language, labels spans.
The text's language is the one whose spans hold most letters; the score is their share.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: First and last code point of the main ranges of each script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["", *dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]
BUCKETS = 1 << 16
#: Numbers that a model holds at most: above CELLS / BUCKETS languages the n-grams share fewer buckets.
CELLS = 1 << 24
#: Score of a word in a language that its script rules out: no sum of n-gram scores or penalties comes near it.
BARRED = -1e9
ORDERS = (1, 2, 3)
#: Characters handled at once; bounds memory (a longer text is handled alone).
GROUP_CHARS = 3_000_000
BLOCK_CHARS = 500_000


class Letters:
    """Script number of every code point seen so far, 0 for what is not a letter."""

    def __init__(self):
        self.script, self.known = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)

    def __call__(self, cp: np.ndarray) -> np.ndarray:
        if not self.known[cp].all():
            for c in np.unique(cp[~self.known[cp]]):
                kind = unicodedata.category(chr(c))[0]
                if kind == "L":
                    name = next((s for s, a, b in SCRIPTS if a <= c <= b), "other")
                    self.script[c] = SCRIPT_NAMES.index(name)
                self.known[c] = True
        return self.script[cp]


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Words:
    """Words of several texts: begin and end in the joined code points, text number, script, and n-grams."""

    def __init__(self, texts: list[str], letters: Letters):
        joined = "\n".join(map(lowered, texts)) + "\n"
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        script = letters(self.cp)
        edge = np.flatnonzero(np.diff(script, prepend=np.uint8(0), append=np.uint8(0)))
        begin, end = edge[:-1], edge[1:]
        keep = script[begin] > 0 if len(begin) else np.zeros(0, bool)
        self.begin, self.end = begin[keep], end[keep]
        self.script = script[self.begin]
        self.text = np.searchsorted(self.base, self.begin, side="right") - 1

    def grams(self, buckets: int):
        """Blocks of (first word, last word, word number within the block, bucket) of hashed n-grams with word ends."""
        size = np.cumsum(self.end - self.begin)
        first = 0
        while first < len(size):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + BLOCK_CHARS)))
            b, n = self.begin[first:last], (self.end - self.begin)[first:last]
            start = np.concatenate([[0], np.cumsum(n + 2)])
            row = np.repeat(np.arange(last - first), n + 2)
            at = np.arange(start[-1]) - start[:-1][row]
            inside = (at > 0) & (at <= n[row])
            c = np.full(len(row), 3, np.uint64)
            c[inside] = self.cp[(b[row] + at - 1)[inside]]
            rows, hashed = [], []
            for k in ORDERS:
                if len(c) < k:
                    continue
                h = np.full(len(c) - k + 1, k, np.uint64)
                for j in range(k):
                    h = (h ^ c[j : len(c) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                ok = row[: len(h)] == row[k - 1 :]
                if k == 1:
                    ok &= inside
                rows.append(row[: len(h)][ok])
                hashed.append((h[ok] >> np.uint64(7)).astype(np.int64) % buckets)
            yield first, last, np.concatenate(rows), np.concatenate(hashed)
            first = last


def groups(texts: list[str]):
    """Ranges of texts of GROUP_CHARS together; a longer text alone."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if i > first and chars + len(t) > GROUP_CHARS:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def viterbi(score: np.ndarray, begin: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of score. Texts are rows begin[i] to begin[i] + n[i]; all advance together."""
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]
    n_lang = score.shape[1]
    kind = np.uint8 if n_lang <= 1 << 8 else np.uint16 if n_lang <= 1 << 16 else np.uint32
    back = np.zeros(score.shape, kind)
    own = np.arange(n_lang, dtype=kind)
    best = np.zeros((len(n), n_lang), np.float32)
    steps = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(steps), side="left")
    for t in range(steps):
        k = alive[t]
        v, rows = best[:k], begin[:k] + t
        top = v.argmax(1)
        switch = v[np.arange(k), top][:, None] - penalty
        stay = v >= switch
        back[rows] = np.where(stay, own, top.astype(kind)[:, None])
        best[:k] = np.where(stay, v, switch) + score[rows]
    label = np.zeros(len(score), kind)
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        rows = begin[:k] + t
        label[rows] = state[:k]
        state[:k] = back[rows, state[:k]]
    return label


class Model:
    """Log-probabilities of buckets and candidate languages of scripts, from counts of learned words.

    counts: one row per language, of its n-grams' buckets and then its words' scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5, rare: float = 0.001):
        self.langs, self.buckets = langs, counts.shape[1] - len(SCRIPT_NAMES)
        grams, scripts = counts[:, : self.buckets], counts[:, self.buckets :]
        total = grams.sum(1, keepdims=True)
        # N-grams of one word overlap: a word counts as much as its letters, not all orders of them.
        self.logp = (np.log((grams + smoothing) / (total + smoothing * self.buckets)) / len(ORDERS)).astype(np.float32)
        seen = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = seen >= rare
        allowed[:, ~allowed.any(0)] = True  # a script never learned narrows nothing
        self.candidates = [np.flatnonzero(allowed[:, s]) for s in range(len(SCRIPT_NAMES))]

    def scores(self, w: Words) -> np.ndarray:
        """Score of each word in each language: only those that the word's script leaves are computed."""
        score = np.full((len(w.begin), len(self.langs)), BARRED, np.float32)
        for first, last, row, bucket in w.grams(self.buckets):
            script = w.script[first:last]
            for s in np.unique(script):
                rows = np.flatnonzero(script == s)
                mine = slice(None) if len(rows) == len(script) else np.flatnonzero(script[row] == s)
                for j in self.candidates[s]:
                    score[first + rows, j] = np.bincount(row[mine], self.logp[j][bucket[mine]], last - first)[rows]
        return score

    def spans(self, texts: list[str], letters: Letters, penalty: float):
        """Per text: language, score, and spans (begin, end, language) in characters."""
        w = Words(texts, letters)
        score = self.scores(w)
        n = np.bincount(w.text, minlength=len(texts))
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n
        label = viterbi(score, begin, n, penalty)
        size = w.end - w.begin
        letters_of = np.zeros((len(texts), len(self.langs)))
        np.add.at(letters_of, (w.text, label), size)
        cut = np.flatnonzero((np.diff(w.text, prepend=-1) != 0) | (np.diff(label.astype(int), prepend=-1) != 0))
        ends = np.concatenate([cut[1:], [len(label)]]).astype(int) - 1 if len(cut) else cut
        spans: list[list] = [[] for _ in texts]
        for i, j in zip(cut.tolist(), ends.tolist(), strict=True):
            t = int(w.text[i])
            spans[t].append({"begin": int(w.begin[i] - w.base[t]), "end": int(w.end[j] - w.base[t]), "lang": self.langs[label[i]]})
        for t in range(len(texts)):
            if n[t]:
                k = int(letters_of[t].argmax())
                yield self.langs[k], float(letters_of[t, k] / letters_of[t].sum()), spans[t]
            else:
                yield "und", 0.0, []


def _count(langs: list[str], buckets: int):
    def run(batches):
        import pyarrow as pa

        letters, number = Letters(), {x: i for i, x in enumerate(langs)}
        counts: dict[int, np.ndarray] = {}
        for b in slices(batches):
            texts, of = b.column(0).to_pylist(), np.array([number[x] for x in b.column(1).to_pylist()])
            for i, j in groups(texts):
                w = Words(texts[i:j], letters)
                lang = of[i:j][w.text]
                for k in np.unique(lang).tolist():
                    if k not in counts:
                        counts[k] = np.zeros(buckets + len(SCRIPT_NAMES), np.int64)
                    counts[k][buckets:] += np.bincount(w.script[lang == k], minlength=len(SCRIPT_NAMES))
                for first, last, row, bucket in w.grams(buckets):
                    whose = lang[first:last][row]
                    for k in np.unique(whose).tolist():
                        counts[k][:buckets] += np.bincount(bucket[whose == k], minlength=buckets)
        for k, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    return run


def learn(labelled: DataFrame, per_lang: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of the rows with a language and a text; None if there are none.

    It is fitted on a bounded sample, about per_lang texts of each language, drawn by a hash of id and text. The driver
    gets one number per language and bucket, CELLS at most, whatever the number of texts and languages.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    langs = sorted(sizes)
    buckets = min(BUCKETS, 1 << max(8, (CELLS // len(langs)).bit_length() - 1))
    million = 1_000_000
    drawn = F.pmod(F.xxhash64("id", "text", F.lit("language sample")), F.lit(million))
    limits = rows.sparkSession.createDataFrame([(lang, min(million, -(-per_lang * million // sizes[lang]))) for lang in langs], "of string, share int")
    sample = rows.join(F.broadcast(limits), F.col("lang") == F.col("of")).filter(drawn < F.col("share")).select("text", "lang")
    found = sample.mapInArrow(_count(langs, buckets), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), buckets + len(SCRIPT_NAMES)), np.float32)
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, counts)


def _predict(model: Model | None, penalty: float, id_name: str):
    def run(batches):
        import pyarrow as pa

        letters = Letters()
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in slices(batches):
            for i, j in groups([x or "" for x in b.column(1).to_pylist()]):
                texts = [x or "" for x in b.column(1).slice(i, j - i).to_pylist()]
                out = list(model.spans(texts, letters, penalty)) if model else [("und", 0.0, [])] * len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], span)], [id_name, "lang_pred", "score", "spans"])

    return run


def predict(docs: DataFrame, model: Model | None, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score, spans of (begin, end, lang) in characters.

    lang_pred is und, with score 0, for a text that is null, has no letter, or when nothing was learned.
    Ties go to the language first in code-point order. Repeated rows and ids each give a row; further columns
    of docs are ignored, whatever their names. An empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(_predict(model, penalty, id_col), f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string>>")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
