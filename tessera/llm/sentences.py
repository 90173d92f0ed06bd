"""Sentence boundaries across languages and scripts.

Boundary rules are compiled into a finite transducer over a small alphabet of events (terminators, quotes,
brackets, hard line breaks, spaces between Thai letters, other text). A right-to-left automaton first tells
what follows the quote or bracket that closes next, a left-to-right one then emits the boundaries (together a
bimachine, so every rule needs bounded context only). Texts up to ``CHUNK`` characters are read in one go from
the start states. Longer ones are cut into chunks that spread over the cluster; each chunk becomes a function
from states to states, the functions of one text are composed by a parallel prefix scan, and each chunk is
then read once more from its own start state. The results are the same wherever a text is cut.

Defined results: null and blank texts and unavailable markers have no sentences; a blob is one sentence; a
quotation that never closes is ordinary text; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CHUNK = 10_000
MARGIN = 80

# Abbreviations by what may follow them.
TITLES = frozenset("dr mr mrs ms prof sr sra srta dra m mm mme mlle me st hr fr dipl ing rev gen sen rep gov capt col lt डॉ श्री श्रीमती د أ".split())
JOINING = frozenset("vs cf vgl approx aprox ca circa bzw ggf evtl inkl exkl zzgl sog bspw mio mrd tsd mn ee viz incl e.g i.e eg ie z.b d.h u.a p.ej z d".split())
NUMBERED = frozenset("no nos nr nrn núm num sec secs art arts abs p pp s vol fig ch cap pág pag ziff kap bd ref réf tel ext para jan feb mar apr jun jul aug sep sept oct nov dec n°".split())
ENDING = frozenset("etc usw inc corp ltd co plc llc p.m a.m uds uu u.s e.u u.k u.n u.s.a est dept jr ff bros".split())
PLACES = frozenset("u.s e.u u.k u.n u.s.a".split())
ATTACHED = frozenset("Treasury Treasuries Government Congress Senate House Department Federal Army Navy Supreme District Court Dollar Dollars Bank Commission Council Parliament President Secretary Securities Food Patent Customs Postal".split())
GERMAN_BEFORE = frozenset("am im vom zum den der dem des bis seit ab beim".split())
GERMAN_AFTER = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Quartal Halbjahr Jahrhundert Tag Woche Monat Jahr Stock Etage Platz Auflage".split())
SPECIAL = TITLES | JOINING | NUMBERED | ENDING
PARTICLES = frozenset("とがはをのにもでなやへって")

SOFT = "\x1f"  # a line break inside a hard-wrapped paragraph
SPACES = r"\s\x1f\u00a0\u202f"
BLANKS = " \t\r\n\x1f\u00a0\u202f\u3000\u2009\u200a\u2002\u2003"
BULLET = re.compile(r"[ \t]*(?:[-•*–·▪◦]|\d{1,3}[.)]|\(\w\))[ \t ]")
UNAVAILABLE = re.compile(r"\s*\[[^\[\]]*\bunavailable\b[^\[\]]*\]\s*\Z", re.I)
WRAP_LEAST, WRAP_MOST, WRAP_USUAL = 50, 100, 78

#: The look-ahead names what an event can begin with, so that other characters are passed at little cost.
EVENT = re.compile(
    rf"(?=[\n.!?…。！？｡।॥؟„«「『‹”»」』›\"“(（\[【)）\]】 \u00a0\x1f])(?:(?P<n>\n)"
    rf"|(?P<t>[.!?…。！？｡।॥؟]+)(?P<c>(?:[”’」』）】)\]]|[\"“](?!\w)|[ \u00a0\u202f\x1f]?[»›])*)"
    rf"|(?P<o>[„«「『‹])|(?P<k>[”»」』›])|(?P<q>[\"“])"
    rf"|(?P<b>[(（\[【])|(?P<d>[)）\]】])"
    rf"|(?P<s>(?<=[฀-๿])[ \u00a0\x1f]+(?=[฀-๿])))"
)
SHUT, UNQUOTE, INITIALS = re.compile(r"[)）\]】]"), re.compile(r"[\"“”’」』»›]"), re.compile(r"[^\W\d_](\.[^\W\d_])*\Z")
#: The end of a sentence that the next one follows without a space.
GLUED = re.compile(r"^.*[^\W\d_]{3,}[.!?](?=[A-Z])")
WORD_BREAK = re.compile(r"[\s\x1f\"“„«(\[（]")
NEXT_WORD = re.compile(rf"[{SPACES}]*([^{SPACES}]?[^{SPACES},.;:!?)”\"]*)")

# The alphabet of the transducer.
TEXT, OPEN_Q, OPEN_QC, CLOSE_Q, OPEN_B, OPEN_BC, CLOSE_B, BREAK, THAI = range(9)
TERM = 9  # TERM + 4*starts + 2*closes_bracket + closes_quote
KINDS = TERM + 8
#: States: content*9 + quote*3 + bracket; quote and bracket are none, inside a larger sentence, or opening one.
STATES = 18


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """next[kind, state] and emit[kind, state]."""
    nxt, emit = np.zeros((KINDS, STATES), np.int8), np.zeros((KINDS, STATES), bool)
    for state in range(STATES):
        content, quote, bracket = state // 9, state // 3 % 3, state % 3
        for kind in range(KINDS):
            c, q, b, out = content, quote, bracket, False
            if kind == TEXT:
                c = 1
            elif kind in (OPEN_Q, OPEN_QC):
                q, c = (2 if kind == OPEN_Q and not content else 1), 1
            elif kind == CLOSE_Q:
                q, c = 0, 1
            elif kind in (OPEN_B, OPEN_BC):
                b, c = (2 if kind == OPEN_B and not content else 1), 1
            elif kind == CLOSE_B:
                b, c = 0, 1
            elif kind == BREAK:
                out, c, q, b = bool(content), 0, 0, 0
            elif kind == THAI:
                out = bool(content) and q != 1 and b != 1
                c = 0 if out else c
            else:
                starts, closes_b, closes_q = kind - TERM >> 2 & 1, kind - TERM >> 1 & 1, kind - TERM & 1
                q, b = (0 if closes_q else q), (0 if closes_b else b)
                out = bool(starts) and q != 1 and b != 1
                c = 0 if out else 1
            nxt[kind, state], emit[kind, state] = c * 9 + q * 3 + b, out
    return nxt, emit


NEXT, EMIT = _compile()
#: What the right-to-left automaton knows of the next closing quote and bracket: none, a sentence may start after it, or the sentence goes on.
NONE, AFTER_START, AFTER_MORE = range(3)
RIGHT_STATES = 9


def mark_breaks(text: str) -> str:
    """The text with the line breaks inside hard-wrapped paragraphs replaced by ``SOFT`` (same length)."""
    if "\n" not in text:
        return text
    lines = text.split("\n")
    blocks, start = [], None
    for i, x in enumerate([*lines, ""]):
        plain = i < len(lines) and x.strip() and not BULLET.match(x) and len(x) <= WRAP_MOST
        if plain and start is None:
            start = i
        elif not plain and start is not None:
            if i - start > 1:
                blocks.append((start, i))
            start = None

    def unspaced(ch: str) -> bool:
        return "\u2e80" <= ch <= "\uffef" or "\u0e00" <= ch <= "\u0e7f"

    def runs_on(i: int) -> bool:
        """Whether, in a wrapped text, line i+1 plainly goes on with the sentence of line i."""
        a, b = lines[i].rstrip(), lines[i + 1].lstrip()
        return len(a) >= WRAP_LEAST and not a[-1] in ".!?:" and b[0].islower()

    def overflows(i: int, width: int) -> bool:
        """Whether the first word of line i+1 would not have fitted on line i.

        Scripts without spaces aren't wrapped at words, so their lines are paragraphs.
        """
        a, b = lines[i].rstrip(), lines[i + 1].lstrip()
        if unspaced(a[-1]) or unspaced(b[0]):
            return False
        return len(a) >= WRAP_LEAST and len(a) + (0 if a.endswith("-") else 1) + len(b.split(' ', 1)[0]) > width  # a no-break space doesn't break

    widths = []
    for lo, hi in blocks:
        width = max(len(lines[i]) for i in range(lo, hi))
        if hi - lo >= 3 and all(overflows(i, width) for i in range(lo, hi - 1)):
            widths.append(width)
    usual = max(widths, default=WRAP_USUAL)
    seps = ["\n"] * (len(lines) - 1)
    for lo, hi in blocks:
        for i in range(lo, hi - 1):
            if len(lines[i]) <= usual and (overflows(i, usual) or (widths and runs_on(i))):
                seps[i] = SOFT
    return "".join(x for pair in zip(lines, [*seps, ""], strict=True) for x in pair)


def _starts(text: str, at: int) -> bool:
    """Whether the next word may begin a sentence: not in lower case, unless a name like eVolt."""
    m = NEXT_WORD.match(text, at)
    w = m[1].lstrip("\"“„«‹「『([（【¿¡#*•-–—'‘")
    if not w:
        return True
    return not w[0].islower() or bool(re.match(r"[^\W\d_]{1,3}[A-Z]", w) and w[0].islower() and any(ch.isupper() for ch in w[1:4]))


def _term(text: str, m: re.Match) -> int | None:
    """The event of a terminator, or None if it is part of a word."""
    run, closers, end = m["t"], m["c"], m.end()
    closes = ((2 if SHUT.search(closers) else 0) | (1 if UNQUOTE.search(closers) else 0)) if closers else 0
    after = text[end : end + 1]
    apart = not after or after.isspace() or after == SOFT

    def event(starts: bool) -> int:
        return TERM + 4 * starts + closes

    last = run[-1]
    if last in "。！？｡":
        if after and after in "，、；：,;」』”）" and not closers:
            return event(False)
        if closers and (after in PARTICLES or after in "，、；：,;") and after:
            return event(False)
        return event(True)
    if last in "।॥":
        return event(True)
    if "!" in run or "?" in run or "؟" in run:
        if closers:
            return event(_starts(text, end) and (apart or not after.isalnum() or after.isupper()))
        if apart:
            return event(True)
        if after.isalpha():
            return event(not after.islower()) if not after.isascii() or after.isupper() else None
        return event(after in "\"“„«「(") if after in "\"“„«「(,;:" else None
    word = WORD_BREAK.split(text[max(0, m.start() - 40) : m.start()])[-1].strip("'’‘")
    if "." in word:
        word = GLUED.sub("", word)
    if len(run) > 1 or run == "…":
        if not apart and after and ord(after) > 0x2E80:
            return event(False)
        return event(_starts(text, end) and not (NEXT_WORD.match(text, end)[1][:1].isdigit()) and (apart or after.isupper()))
    if closers:
        return event(_starts(text, end)) if apart or not after.isalnum() else event(False)
    if not apart:
        if after.isalnum() or after in "\"“„«「":
            letters = len(word) >= 3 and word[-3:].isalpha()
            if letters and not re.search(r"[/@\\:]|www", word):
                nxt = re.match(r"[\"“„«「]?(\w+)", text[end : end + 24])
                w = nxt[1] if nxt else ""
                if after in "\"“„«「" or re.match(r"[^\W\d_]{1,3}[A-Z]|\d{4}(?!\d)", w) or (w[:1].isupper() and (len(w) == 1 or w[1:2].islower() or word.isupper())) or (w and not w[0].isascii() and w[0].isalpha() and w[0].upper() == w[0].lower()):
                    return event(True)
            return None
        return event(False)
    low = word.lower()
    if low not in SPECIAL and len(word) > 3 and word.isalpha():
        return event(True)
    first = NEXT_WORD.match(text, end)[1].lstrip("\"“„«‹「([（¿¡'‘")
    if low in JOINING:
        return event(False)
    if low in TITLES and (word[:1].isupper() or not word.isascii()):
        return event(False)
    if low in NUMBERED and (len(low) > 1 or first[:1].isdigit()):
        return event(bool(first) and first[0].isupper())
    if low in ENDING:
        if low in PLACES and first in ATTACHED:
            return event(False)
        return event(_starts(text, end))
    if len(word) < 8 and INITIALS.match(word):
        return event(False) if len(word) > 1 or word.isupper() else event(True)
    if len(word) <= 3 and word.isdigit():
        begin = m.start() - len(word)
        before = text[max(0, begin - 20) : begin]
        if not before.strip() or before.rstrip(" \t").endswith("\n"):
            return event(False)  # a list number
        if first in GERMAN_AFTER or (first[:1].isupper() and before.split() and before.split()[-1].lower() in GERMAN_BEFORE and before[-1:].isspace()):
            return event(False)
    return event(True)


def events(text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(kind, begin, end) of ``text[lo:hi]``; quotes and brackets that open still lack what follows their close.

    The text around the range serves as context, at most ``MARGIN`` characters of it.
    """
    out: list[tuple[int, int, int]] = []
    at = lo
    for m in EVENT.finditer(text, lo):  # no end is given, as it would hide what follows
        i = m.start()
        if i >= hi:
            break
        g = m.lastgroup
        kind: int | None
        if g == "n":
            kind = BREAK
        elif g in ("t", "c"):
            kind = _term(text, m)
        elif g == "o":
            kind = OPEN_Q
        elif g == "k":
            kind = CLOSE_Q
        elif g == "q":
            prev, nxt = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
            opens = (not prev or prev.isspace() or prev in SOFT + "(（[：:，。！？-—*" or (not prev.isalnum() and nxt.isalnum() and prev not in ",.!?…")) and nxt and not nxt.isspace()
            opens = opens or (prev in ".!?…" and nxt.isalnum())
            kind = OPEN_Q if opens else CLOSE_Q
        elif g == "b":
            kind = OPEN_B
        elif g == "d":
            kind = CLOSE_B
        else:
            kind = THAI
        if kind is None:
            continue
        if i > at and (text[at] not in BLANKS or text[at:i].strip()):
            out.append((TEXT, at, i))
        out.append((kind, i, m.end()))
        at = m.end()
    gap = text[at:hi]
    if gap.strip():
        out.append((TEXT, at, hi))
    return out


def look_right(ev: list[tuple[int, int, int]], state: int) -> tuple[list[tuple[int, int, int]], int]:
    """The events with opening quotes and brackets resolved, and the state of the right-to-left automaton at their left end."""
    q, b = divmod(state, 3)
    out = list(ev)
    for i in range(len(ev) - 1, -1, -1):
        kind, lo, hi = ev[i]
        if kind == BREAK:
            q = b = NONE
        elif kind == CLOSE_Q:
            q = AFTER_MORE
        elif kind == CLOSE_B:
            b = AFTER_MORE
        elif kind == OPEN_Q:
            out[i] = (TEXT if q == NONE else OPEN_Q if q == AFTER_START else OPEN_QC, lo, hi)
            q = NONE
        elif kind == OPEN_B:
            out[i] = (TEXT if b == NONE else OPEN_B if b == AFTER_START else OPEN_BC, lo, hi)
            b = NONE
        elif kind >= TERM:
            f = AFTER_START if kind - TERM & 4 else AFTER_MORE
            q = f if kind - TERM & 1 else q
            b = f if kind - TERM & 2 else b
    return out, q * 3 + b


def emit(text: str, ev: list[tuple[int, int, int]], state: int) -> tuple[list[int], int]:
    """The ends of the sentences that end in these (resolved) events, and the state after them."""
    ends, last = [], 0
    nxt, out = NEXT, EMIT
    for kind, lo, hi in ev:
        if out[kind, state]:
            if kind == BREAK or kind == THAI:
                e = lo
                while text[e - 1].isspace() or text[e - 1] == SOFT:
                    e -= 1
            else:
                e = hi
            ends.append(e)
        state = int(nxt[kind, state])
        last = hi
    return ends, state


def _last_end(text: str) -> int:
    e = len(text)
    while e and (text[e - 1].isspace() or text[e - 1] == SOFT):
        e -= 1
    return e


def sentence_ends(text: str | None) -> list[int]:
    """The end of every sentence of a text, read in one go."""
    if not text or not text.strip() or UNAVAILABLE.match(text):
        return []
    marked = mark_breaks(text)
    ev, _ = look_right(events(marked, 0, len(marked)), 0)
    ends, state = emit(marked, ev, 0)
    if state >= 9:
        ends.append(_last_end(marked))
    return ends


def cut_points(text: str, size: int) -> list[int]:
    """Where to cut a long text: after white space, so that no word is torn."""
    cuts, at = [0], size
    while at < len(text):
        e = at
        while e < len(text) and not (text[e - 1].isspace() or text[e - 1] == SOFT):
            e += 1
        if e >= len(text):
            break
        # not before white space or inside a run of it, where an event may span the cut
        while e < len(text) and (text[e].isspace() or text[e] in SOFT + "»›"):
            e += 1
        cuts.append(e)
        at = e + size
    return [*cuts, len(text)]


def _resolve() -> tuple[np.ndarray, np.ndarray]:
    """[kind, right state]: what ``look_right`` makes of an event read in a right state, and the state left of it."""
    kinds, states = np.zeros((KINDS, RIGHT_STATES), np.int8), np.zeros((KINDS, RIGHT_STATES), np.int8)
    for kind in range(KINDS):
        for state in range(RIGHT_STATES):
            got, states[kind, state] = look_right([(kind, 0, 0)], state)
            kinds[kind, state] = got[0][0]
    return kinds, states


RESOLVED, RIGHT = _resolve()


def chunk_function(ev: list[tuple[int, int, int]]) -> np.ndarray:
    """[right state at the right end, 1 + left state at the left end] -> state; column 0 is the right state at the left end.

    All right states, then all pairs of states, are carried through the events together.
    """
    kinds = [k for k, _, _ in ev]
    right = np.arange(RIGHT_STATES, dtype=np.int8)
    seen = [right] * len(kinds)
    for i in range(len(kinds) - 1, -1, -1):
        k = kinds[i]
        seen[i] = RESOLVED[k][right]
        right = RIGHT[k][right]
    state = np.tile(np.arange(STATES, dtype=np.int8), (RIGHT_STATES, 1))
    for k in seen:
        state = NEXT[k[:, None], state]
    return np.hstack([right[:, None], state])


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (n, states): row i is f_i after ... after f_0, in log2(n) steps."""
    out, step = functions.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.int64), 1).astype(out.dtype)
        step *= 2
    return out


def start_states(fs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chunks in order with functions (n, right, 1 + left): the right and left state each chunk is read from."""
    n = len(fs)
    from_right = scan(fs[::-1, :, 0])[::-1]  # row i: right state at the left end of chunk i by the state at the text's end
    right = np.zeros(n, np.int8)
    right[:-1] = from_right[1:, 0]
    left_maps = fs[np.arange(n), right, 1:]
    left = np.zeros(n, np.int8)
    left[1:] = scan(left_maps)[:-1, 0]
    return right, left


CHUNK_SCHEMA = "section_id bigint, no int, base int, lo int, hi int, n int, part string"


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, ends = [], []
        for sid, text in zip(b.section_id, b.text, strict=True):
            got = sentence_ends(text)
            ids += [sid] * len(got)
            ends += got
        yield pd.DataFrame({"section_id": pd.Series(ids, dtype="int64"), "end_pos": pd.Series(ends, dtype="int32")})


def _cut(size: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, text in zip(b.section_id, b.text, strict=True):
                if not text.strip() or UNAVAILABLE.match(text):
                    continue
                marked = mark_breaks(text)
                cuts = cut_points(marked, size)
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    base = max(0, lo - MARGIN)
                    yield pd.DataFrame({"section_id": [sid], "no": [k], "base": [base], "lo": [lo - base], "hi": [hi - base], "n": [len(cuts) - 1], "part": [marked[base : hi + MARGIN]]})

    return run


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"section_id": b.section_id, "no": b.no, "f": [chunk_function(events(p, lo, hi)).tobytes() for p, lo, hi in zip(b.part, b.lo, b.hi, strict=True)]})


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("no")
    fs = np.stack([np.frombuffer(f, np.int8).reshape(RIGHT_STATES, 1 + STATES) for f in pdf.f])
    right, left = start_states(fs)
    return pd.DataFrame({"section_id": pdf.section_id, "no": pdf.no, "right": right.astype("int32"), "left": left.astype("int32")})


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, ends = [], []
        for sid, no, n, base, lo, hi, part, right, left in zip(b.section_id, b.no, b.n, b.base, b.lo, b.hi, b.part, b.right, b.left, strict=True):
            ev, _ = look_right(events(part, lo, hi), right)
            got, state = emit(part, ev, left)
            if no == n - 1 and state >= 9:
                got.append(_last_end(part[:hi]))
            ids += [sid] * len(got)
            ends += [base + e for e in got]
        yield pd.DataFrame({"section_id": pd.Series(ids, dtype="int64"), "end_pos": pd.Series(ends, dtype="int32")})


def sentences(sections: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``section_id, end_pos`` of every sentence, each once.

    The two branches differ only in where a text is read. Repeated sections are read each and their sentences
    taken once, so no short text is shuffled; long texts are rare, and theirs are.
    """
    some = sections.select("section_id", "text").filter(F.col("text").isNotNull())
    out = "section_id bigint, end_pos int"
    short = some.filter(F.char_length("text") <= chunk).mapInPandas(_short, out)
    chunks = some.filter(F.char_length("text") > chunk).dropDuplicates(["section_id"]).mapInPandas(_cut(chunk), CHUNK_SCHEMA).repartition("section_id", "no")
    # one small row per chunk, so a group is as small as a text's length over the chunk size
    states = chunks.mapInPandas(_functions, "section_id bigint, no int, f binary").groupBy("section_id").applyInPandas(_compose, "section_id bigint, no int, right int, left int")
    long = chunks.join(states, ["section_id", "no"]).mapInPandas(_emit, out)
    return short.unionByName(long).distinct()


def sentence_units(sections: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The sentences with their text: ``section_id, no, start_pos, end_pos, sentence`` (start is an offset)."""
    from pyspark.sql import Window

    w = Window.partitionBy("section_id").orderBy("end_pos")
    ends = sentences(sections, chunk).select("section_id", "end_pos", F.coalesce(F.lag("end_pos").over(w), F.lit(0)).alias("start_pos"), F.row_number().over(w).alias("no"))
    once = sections.select("section_id", "text").dropDuplicates(["section_id"])
    raw = F.expr("substring(text, start_pos + 1, end_pos - start_pos)")
    text = F.regexp_replace(raw, r"^(?U)\s+", "")
    return ends.join(once, "section_id").select("section_id", "no", (F.col("end_pos") - F.char_length(text)).alias("start_pos"), "end_pos", text.alias("sentence"))
