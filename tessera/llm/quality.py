"""Per-document text quality statistics, and which documents are natural prose.

Tables and lists show in vertical delimiter alignment (delimiters at the same columns of consecutive lines, or as
many fields a line), indentation periodicity and line-length autocorrelation over several lags; word, symbol and
punctuation ratios tell the rest. The statistics are computed over whole texts, one pass, no shuffle. A softmax regression over them is trained here on the checked sample
(at most ``MAX_LABELLED`` rows, those of the lowest hash) and applied to every document.

Defined results: null and blank texts have zero statistics and are of no kind; repeated labels count once,
contradicting ones keep the least kind; without labels every document is judged by ``prose_share`` alone; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.session import bounded

MAX_LABELLED = 20_000
KINDS = ("code", "junk", "list", "prose", "table")
L2, STEPS, RATE = 0.02, 600, 0.5

# Common words of several languages, and common characters of scripts without spaces.
COMMON = frozenset(
    "the of and to a in is that it for on as was are with be this by or an not which from at has have its if no but when "
    "le la les des du et un une est que dans pour sur par au aux qui ne pas se de "
    "der die das und ist ein eine den dem im zum mit von nicht auf für sich "
    "el los las y en es una por con del al se su "
    "ने को की का के से में है और "
    "في من على إلى أن هل ب".split()
)
CJK_COMMON = "的了是在和与及吗但并于过はがをにのでともした"
CODE_WORDS = frozenset("def return import const let var function class static struct include func package void public private elif endif SELECT FROM WHERE INSERT CREATE impl fn #include".split())
LEAD = re.compile(r"\s*(?:[-*•+]\s|\d{1,3}[.)]\s|#|//|/\*|\*|\||<|@|%|;|--|\"\"\"|'''|REM )")
MARKS = frozenset(" \t-*•+–0123456789")
CALL = re.compile(r"\w\(\w*[,)=]|\)\s*[:{]\Z|\w\[")
LISTED = re.compile(r"[ \t]*(?:[-*•+–]\s|\d{1,3}[.)]\s)")

NAMES = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "code_symbol_ratio", "digit_ratio", "upper_ratio", "punct_line_share", "common_share", "unique_word_share",
    "mean_line_length", "bullet_share", "blank_share", "indent_share", "delimiter_alignment", "indent_period", "length_autocorrelation", "length_spread", "code_word_ratio", "snake_ratio",
    "odd_ratio", "compressibility", "prose_share", "sentence_rate", "listing_share", "column_alignment", "length_period",
)


#: What parts the fields of a line; lags that periodicity is looked for at.
DELIMITERS = ",;|\t:"
LAGS = 8
POINTS = ".!?。！？।؟"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits of the code points below 0x10000: 1 space, 2 letter, 4 digit, 8 code symbol, 16 odd, 32 delimiter, 64 terminator, 128 one that no space follows."""
    bits = np.zeros(0x10000, np.uint8)
    for o in range(0x10000):
        if 0xD800 <= o < 0xE000:
            bits[o] = 16
            continue
        ch = chr(o)
        b = 1 if ch.isspace() else 2 if ch.isalpha() else 4 if ch.isdigit() else 0
        if 0x0900 <= o < 0x0E80 and not b:  # vowel signs and tone marks
            b = 2
        if ch in "{}()[]<>;=_\\|&*+^~@#$%/`":
            b |= 8
        if ch == "�" or o < 32 and ch not in "\n\r\t" or 0x80 <= o < 0xA0 or ch in "ÂÃâ©»¿":
            b |= 16
        if ch in DELIMITERS:
            b |= 32
        if ch in POINTS:
            b |= 64 if ch in ".!?" else 192
        bits[o] = b
    upper = np.array([chr(o).isupper() if not 0xD800 <= o < 0xE000 else False for o in range(0x600)])
    return bits, upper


BITS, UPPER = _tables()


def _prose_line(line: str, thai: bool, cjk: bool) -> bool:
    """Whether a line looks like a part of running text; ``thai`` and ``cjk`` tell whether its text has such letters."""
    if thai and len(line) > 20 and not LEAD.match(line) and sum(1 for ch in line if "\u0e00" <= ch <= "\u0e7f") > 0.6 * len(line):
        return True
    if cjk:
        n_cjk = sum(1 for ch in line if "\u3040" <= ch <= "\u9fff")
        if n_cjk > 0.4 * len(line):
            return not LEAD.match(line) and n_cjk >= 8 and sum(map(line.count, CJK_COMMON)) >= 0.05 * n_cjk and "|" not in line
    if line.count(" ") < 3 and len(line.split()) < 4:
        return False
    low = line.lower().split()
    common = sum(map(COMMON.__contains__, low))
    if common < max(1, 0.12 * len(low)):
        return False
    if LEAD.match(line):
        return False
    bare = line.strip()
    if "(" in bare and CALL.search(bare) or "[" in bare and CALL.search(bare):
        return False
    return "    " not in bare and "\t" not in bare and sum(map(line.count, "{}=<>_\\|;[]")) <= 0.02 * len(line) + 1


def column_alignment(cp: np.ndarray, b: np.ndarray) -> float:
    """Share of the delimiters that stand at the same column as the same delimiter of the line before.

    Delimiters are the marks of ``DELIMITERS`` and the ends of runs of two or more spaces (a column of padded text);
    the white space a line begins with isn't one. ``b`` holds the class bits of the code points.
    """
    breaks = np.flatnonzero(cp == 10)
    if len(breaks) < 2:
        return 0.0
    space = cp == 32
    hit = (b & 32) > 0
    hit[2:] |= space[:-2] & space[1:-1] & ~space[2:] & (cp[2:] != 10)
    at = np.flatnonzero(hit)
    if len(at) < 3:
        return 0.0
    starts = np.concatenate([[0], breaks + 1])
    ink = np.flatnonzero(~(space | (cp == 9) | (cp == 10)))
    line = np.searchsorted(breaks, at)
    # the place of the first ink at or after the start of each line tells whether a delimiter has ink before it
    first = np.searchsorted(ink, starts)
    first = np.where(first < len(ink), ink[np.minimum(first, len(ink) - 1)], len(cp))
    begun = first[line] < at
    at, line = at[begun], line[begun]
    if len(at) < 3:
        return 0.0
    width = int(np.diff(starts, append=len(cp) + 1).max()) + 1
    mark = np.where((b[at] & 32) > 0, cp[at], 32).astype(np.int64)
    key = (line.astype(np.int64) * width + (at - starts[line])) * 0x110000 + mark  # in order, as the places are
    above = key - np.int64(width) * 0x110000
    i = np.minimum(np.searchsorted(key, above), len(key) - 1)
    return float(np.count_nonzero(key[i] == above)) / len(at)


def features(text: str | None) -> list[float]:
    """The statistics of ``NAMES`` for one text."""
    if text is None or not text.strip():
        return [float(len(text or ""))] + [0.0] * (len(NAMES) - 1)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    b = BITS[np.minimum(cp, 0xFFFF)]
    space, letter, digit, code, odd = (int(np.count_nonzero(b & k)) for k in (1, 2, 4, 8, 16))
    ink = max(1, n - space)
    is_upper = UPPER[np.minimum(cp, 0x5FF)]
    upper = int(np.count_nonzero(is_upper))
    top = int(cp.max())
    thai = top >= 0xE00 and bool(((cp >= 0xE00) & (cp < 0xE80)).any())
    cjk = top >= 0x3040 and bool(((cp >= 0x3040) & (cp < 0xA000)).any())
    words = text.split()
    low = text.lower().split()
    n_words = len(words)
    common = sum(map(COMMON.__contains__, low))
    keywords = sum(map(CODE_WORDS.__contains__, words))
    # names in snake or camel case
    camel = int(np.count_nonzero(is_upper[1:] & ((b[:-1] & 2) > 0) & ~is_upper[:-1]))
    names = text.count("_") + camel + text.count(";\n") + text.count("{\n")
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    n_full = len(full)
    tails = [x.rstrip()[-1] for x in full]
    ended = sum(map(".!?。！？।؟…\"”»」:".__contains__, tails))
    bullets = sum(1 for x in full if x[0] in MARKS and LISTED.match(x))
    lengths = np.array([len(x) for x in full], float)
    indented = sum(1 for x in full if x[0] in " \t")
    indents = np.array([len(x) - len(x.lstrip(" \t")) for x in full], float) if indented else np.zeros(n_full)
    prose = sum(len(x) for x in full if _prose_line(x, thai, cjk)) / max(1.0, float(lengths.sum()))
    # items of a list that has no bullets: short lines of few words without an end
    listing = sum(1 for x, e in zip(full, tails, strict=True) if len(x) < 60 and e not in ".!?,:;{}" and len(x.split(None, 8)) <= 7) / n_full

    alignment = 0.0
    if n_full >= 3:
        for d in (",", ";", "\t", "|", "   "):
            if text.count(d) < 0.7 * n_full:
                continue
            counts = np.fromiter((x.count(d) for x in full), int, n_full)
            some = counts[counts > 0]
            if len(some) >= 3 and len(some) >= 0.7 * n_full:
                mode = np.bincount(np.minimum(some, 999)).argmax()
                alignment = max(alignment, float(np.count_nonzero(counts == mode)) / n_full * min(1.0, mode / 2))

    columns = column_alignment(cp, b)

    def auto(x: np.ndarray, lags: int) -> float:
        """The greatest autocorrelation over lags up to ``lags``."""
        y = x - x.sum() / len(x)
        power = float(y @ y)
        if power <= 1e-12:
            return 0.0
        return max((float(y[k:] @ y[:-k]) / power for k in range(1, min(lags, len(y) - 3) + 1)), default=0.0)

    period = auto(indents, LAGS) if indented else 0.0
    sample = text.encode("utf-8", "surrogatepass")
    squeezed = len(zlib.compress(sample, 1)) / len(sample)
    ends = int(np.count_nonzero((b[1:] & 1 > 0) & (b[:-1] & 64 > 0))) + int(np.count_nonzero(b & 128))
    return [
        float(n), float(n_words), float(len(lines)), sum(map(len, words)) / n_words, (n - space - letter - digit) / ink, code / ink, digit / ink, upper / max(1, letter), ended / n_full, common / n_words, len(set(low)) / n_words,
        float(lengths.mean()), bullets / n_full, 1 - n_full / len(lines), indented / n_full, alignment, period, auto(lengths, 1), float(lengths.std() / lengths.mean()),
        keywords / n_words, names / n_words, odd / ink, squeezed, prose, ends / (n / 100), listing, columns, auto(lengths, LAGS),
    ]


_ROW = "doc_id bigint, " + ", ".join(f"{x} double" for x in NAMES)


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([[i, *features(t)] for i, t in zip(b.doc_id, b.text, strict=True)], columns=["doc_id", *NAMES])


def statistics(documents: DataFrame) -> DataFrame:
    """One row of statistics per document."""
    return documents.select("doc_id", "text").mapInPandas(_stats, _ROW)


def _inputs(x: np.ndarray) -> np.ndarray:
    """Model inputs: sizes in logarithms, the rest as it is, bounded."""
    z = x.astype(float).copy()
    for k in ("n_chars", "n_words", "n_lines", "mean_word_length", "mean_line_length"):
        i = NAMES.index(k)
        z[:, i] = np.log1p(np.maximum(z[:, i], 0))
    return np.clip(z, -20, 20)


def fit(x: np.ndarray, y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (inputs + 1, kinds) of a softmax regression."""
    z = _inputs(x)
    mean, scale = z.mean(0), z.std(0) + 1e-6
    z = np.hstack([np.clip((z - mean) / scale, -6, 6), np.ones((len(z), 1))])
    t = np.array([[k == v for k in KINDS] for v in y], float)
    counts = t.sum(0)
    weight = (t * (len(t) / (len(KINDS) * np.maximum(counts, 1)))).sum(1, keepdims=True) ** 0.5
    w = np.zeros((z.shape[1], len(KINDS)))
    v = np.zeros_like(w)
    for _ in range(STEPS):
        a = z @ w
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ ((p - t) * weight) / weight.sum() + L2 * np.vstack([w[:-1], np.zeros((1, len(KINDS)))]) / math.sqrt(len(z))
        v = 0.9 * v - RATE * g
        w = w + v
    return mean, scale, w


def classify(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(probability of prose, index of the kind) of each row of statistics."""
    share = x[:, NAMES.index("prose_share")]
    if model is None:
        return share, np.where(share > 0.5, KINDS.index("prose"), KINDS.index("code"))
    mean, scale, w = model
    z = np.hstack([np.clip((_inputs(x) - mean) / scale, -6, 6), np.ones((len(x), 1))])
    a = z @ w
    p = np.exp(a - a.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p[:, KINDS.index("prose")], p.argmax(1)


def train(documents: DataFrame, doc_labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The model of the labelled sample; at most ``MAX_LABELLED`` rows of statistics come to the driver."""
    known = doc_labels.filter(F.lower(F.trim("kind")).isin(list(KINDS))).groupBy("doc_id").agg(F.min(F.lower(F.trim("kind"))).alias("kind"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    known = bounded(known, MAX_LABELLED)  # so the documents' texts need no shuffle
    got = statistics(documents.join(known.select("doc_id"), "doc_id", "left_semi")).join(known, "doc_id").filter("n_words > 0").toPandas().sort_values("doc_id")  # sorted here: Spark would read the texts once more to sample
    if got.kind.nunique() < 2 or "prose" not in set(got.kind):
        return None
    return fit(got[list(NAMES)].to_numpy(), list(got.kind))


def judged(documents: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """Every document's statistics with ``kind``, ``prose_score`` and ``is_prose``."""
    model = train(documents, doc_labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([[i, *features(t)] for i, t in zip(b.doc_id, b.text, strict=True)], columns=["doc_id", *NAMES])
            if not len(rows):
                continue
            score, kind = classify(rows[list(NAMES)].to_numpy(float), model)
            some = (rows.n_words > 0).to_numpy()
            rows["kind"] = [KINDS[k] if s else None for k, s in zip(kind, some, strict=True)]
            rows["prose_score"] = np.where(some, score, 0.0)
            rows["is_prose"] = some & (kind == KINDS.index("prose"))
            yield rows

    return documents.select("doc_id", "text").mapInPandas(run, _ROW + ", kind string, prose_score double, is_prose boolean")


def found(documents: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """The documents that are mainly running prose."""
    return judged(documents, doc_labels).filter("is_prose").select("doc_id").distinct()
