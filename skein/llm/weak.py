"""Weak supervision: expectation-maximisation over vote patterns, and the text statistics rules vote on."""

from __future__ import annotations

import numpy as np

#: Frequent function words of the languages at hand.
STOPWORDS = {
    "en": "the of and to a in is that for it as was with be by on are this from or at an which",
    "de": "der die und das den von zu mit des im dem nicht ein eine als auch es an auf für ist sich",
    "fr": "le la les de et des du en un une que est pour dans par qui sur au ne se pas plus avec",
    "es": "el la los de y que en las del se un una por con para no su al es lo como más",
}
ABSTAIN, BAD, GOOD = 0, 1, 2


def fit_em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tol: float = 1e-7, most_blame: float = 0.02) -> dict:
    """Two hidden classes (0 bad, 1 good); votes 0 abstain, 1 bad, 2 good, independent given the class.

    patterns: distinct vote vectors, one row each; counts: how many documents have each. An abstention says
    nothing of the class. Starts from the belief that rules seldom blame good documents, so that bad votes,
    whichever they are, make a document bad; kinds of bad documents that different rules catch then stay one class.
    No rule may come to blame good documents more often than bad ones, nor more than most_blame of them, so the
    classes keep their meaning. Returns the prior of good, blame[rule, class] (probability that a vote is bad), the
    posterior of good by pattern, and each rule's accuracy when it votes.
    """
    counts = np.asarray(counts, dtype=float)
    patterns = np.asarray(patterns, dtype=np.int64)
    is_bad, is_good = (patterns == BAD).astype(float), (patterns == GOOD).astype(float)
    post = 1 / (1 + np.exp(3.0 * is_bad.sum(1) - 3.0))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post], 1)
        prior = (weight[:, 1].sum() + 4) / (weight.sum() + 5)
        n_bad, n_good = is_bad.T @ weight, is_good.T @ weight
        blame = (n_bad + [0.35, 0.05]) / (n_bad + n_good + 1)
        blame[:, 1] = np.minimum(np.minimum(blame[:, 1], most_blame), blame[:, 0])
        logp = np.log([1 - prior, prior]) + is_bad @ np.log(blame) + is_good @ np.log1p(-blame)
        logp -= logp.max(1, keepdims=True) if len(counts) else 0
        new = np.exp(logp[:, 1]) / np.exp(logp).sum(1)
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < tol:
            break
    weight = np.stack([counts * (1 - post), counts * post], 1)
    n_bad, n_good = is_bad.T @ weight, is_good.T @ weight
    accuracy = (n_bad[:, 0] + n_good[:, 1] + 0.5) / (n_bad.sum(1) + n_good.sum(1) + 1)
    return {"prior": float(prior), "blame": blame, "posterior": post, "accuracy": accuracy}


class TextStats:
    """Counts of one text that rules vote on. Words are maximal runs of anything but ASCII white space."""

    def __init__(self):
        self.stop = {w.encode() for ws in STOPWORDS.values() for w in ws.split()}
        self.upper = frozenset(range(65, 91))

    def __call__(self, text: str | None) -> dict:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        lines = {}
        n_lines = 0
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                n_lines += 1
                lines[line] = lines.get(line, 0) + 1
        distinct = set(words)
        return {
            "n_words": n,
            "word_chars": len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
            "n_symbols": sum(map(text.count, "#*$%&|<>")),
            "n_lines": n_lines,
            "n_dup_lines": n_lines - len(lines),
            "n_repeat_words": repeat_words(words),
            "n_distinct": len(distinct),
            "n_same_next": sum(map(bytes.__eq__, words, words[1:])),
            "n_stop": len(distinct & self.stop),
            "n_shout": sum(map(bytes.isupper, words)),
            "n_bangs": text.count("!"),
            "n_stops": text.count(".") + text.count("?"),
            "n_digits": sum(map(text.count, "0123456789")),
        }


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    n, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def _vote(value: float, good: float, bad: float) -> int:
    """good below good, bad above bad, abstains between."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def votes(s: dict) -> list[int]:
    """One vote per rule, in the order of RULES. A text without words gets abstentions only."""
    n = s["n_words"]
    if not n:
        return [ABSTAIN] * len(RULES)
    mean = s["word_chars"] / n
    spread = s["n_distinct"] / n
    return [
        _vote(s["n_symbols"] / n, 0.02, 0.1),
        _vote(s["n_dup_lines"] / s["n_lines"], 0.1, 0.4) if s["n_lines"] >= 4 else ABSTAIN,
        _vote(s["n_repeat_words"] / n, 0.1, 0.3) if n >= 50 else ABSTAIN,
        _vote(s["n_same_next"] / n, 0.05, 0.15) if n >= 10 else ABSTAIN,
        _vote(s["n_shout"] / n, 0.1, 0.3) if n >= 10 else ABSTAIN,
        _vote(s["n_bangs"] / n, 0.05, 0.25),
        GOOD if 3 <= mean <= 10 else BAD if mean < 2 or mean > 14 else ABSTAIN,
        (GOOD if s["n_stop"] >= 4 else BAD if s["n_stop"] == 0 else ABSTAIN) if n >= 50 else ABSTAIN,
        (BAD if spread < 0.2 else GOOD if spread > 0.4 else ABSTAIN) if 30 <= n <= 3000 else ABSTAIN,
        _vote(s["n_digits"] / s["word_chars"], 0.05, 0.2),
        GOOD if s["n_stops"] / n >= 0.01 else ABSTAIN,
        _vote(s["n_symbols"] / s["word_chars"], 0.01, 0.05),
    ]


RULES = ["symbols", "dup_lines", "repeat_windows", "same_next", "shouting", "bangs", "word_length", "stopwords", "spread", "digits", "sentence_ends", "symbol_chars"]


def pattern_code(v: list[int]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x
    return code


def pattern_votes(code: int, n_rules: int = len(RULES)) -> list[int]:
    out = []
    for _ in range(n_rules):
        code, x = divmod(code, 3)
        out.append(x)
    return out[::-1]


def posterior_by_pattern(rows, n_rules: int = len(RULES)) -> tuple[dict[int, float], dict]:
    """rows: (pattern code, documents). At most 3 ** rules of them, whatever the size of the corpus."""
    codes = [int(c) for c, _ in rows]
    fit = fit_em(np.array([pattern_votes(c, n_rules) for c in codes], dtype=np.int64).reshape(len(codes), n_rules), np.array([float(n) for _, n in rows]))
    return dict(zip(codes, map(float, fit["posterior"]), strict=True)), fit
