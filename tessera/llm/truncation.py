"""Text cut off by field limits or in transfer.

The length hazard of each field and source (how many values end at a length, of those that reach it) is
computed by window functions and tested against the hazards of neighbouring lengths; the Benjamini-Hochberg
procedure controls false discoveries over all lengths of all fields, sources and units together. Significant
lengths are the field limits. Values whose ending is incomplete are cut: by the limit at a significant length, in
transfer at any other.

An ending is judged by its structure (code block, table row, quotation, bracket, number, terminator). Where that
leaves it open (abbreviations, list items, headings, figures, sources, short remarks), the odds that such an ending
is whole come from how often it is one where nothing can have been cut, namely before the last sentence or line of
all values; at a significant length they are multiplied by the odds that a value ends there by itself, taken from
the endings of that length that structure decides (a limit tears most of them, a phrase that recurs none).

Texts are read once, by one pass that yields a small row per value and pre-aggregated evidence; no text is
shuffled.

Defined results: null and blank values and bracketed notes are whole; repeated rows are one value (as evidence
each counts, which leaves shares as they are); a value without a known source is tested under the source ''; an empty table gives no cases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.nested import EVENT_COLLECTIONS, NestedTables, Scalar
from tessera.session import cut

from .sentences import ENDING, EVENT, JOINING, NUMBERED, TERM, TITLES, _term

#: Lengths on either side that a hazard is compared with; share of false discoveries. A discovery is a limit from the least
#: count and the least multiple of what its neighbours lead to expect, as over much data every small difference is significant.
NEIGHBOURS, FALSE_SHARE, LEAST, LEAST_RATIO = 25, 0.001, 5, 5.0
#: Occurrences that a key needs before it decides, and the share of them that must be endings.
SEEN, ENDS = 3, 0.5
#: What is added to both counts of a key, so that a single sighting isn't certainty; and the share taken where none was seen.
HALF, SURE = 0.5, 0.9
SALT = 8

VERDICT = Scalar("verdict", "verdict", ("judge", "review"), "text")
REASONING = Scalar("reasoning", "reasoning", ("judge", "news_verify"), "text")

CLOSERS = "\"“”’»」』）)】]*_"
FINAL = ".!?。！？｡।॥؟"
MARKER = re.compile(r"(?:\.{3}|…)?\s*[\[(（](?:more|truncated|cut(?: off)?|continued|cont\.?|snip|clipped|\.\.\.|…)[\])）]\s*\Z|…\s*\Z|�+\s*\Z", re.I)
NOTE = re.compile(r"\s*\[[^\[\]]*\]\s*\Z")
BULLET = re.compile(r"\s*(?:[-•*–·]|\d{1,3}[.)])\s+")
SEMICOLON = re.compile("[;；؛]")
FIGURE = re.compile(r"\s*(?:[-•*–·]\s+)?[^:]{1,60}:\s*[^\w\s]{0,3}\s?\d[\d.,]*\s*\S{0,3}\s*\Z")
LISTED = re.compile(r"\s*([A-Za-z]\w{2,20}):\s*(\S+(?:,\s+\S+)*),?\s*\Z")
TOKEN = re.compile(r"\S+")
DIGITS = re.compile(r"\d+")
#: A reference that closes a text, as a signature does.
CLOSING = re.compile(r"(?:^|[\s])Ref\.?:? [A-Z0-9][A-Z0-9-]{2,}\.\Z")
SHORT = 40
STOP = re.compile(r"[.!?][\"“”»)]*(?=\s)")
LAST_STOP = re.compile(r"(?<=[.!?])[\"“”»)]*\s+")
#: A sentence that trails off by intent is known by recurring as a whole; shorter ones recur by chance.
TRAILING = 20
OPENERS = "(\"“«„["
NUMBER = re.compile(r"[$€£¥₹]?\d[\d.,]*\Z")
ABBREVIATIONS = TITLES | JOINING | NUMBERED | ENDING


def _shape(s: str) -> str:
    return DIGITS.sub("0", " ".join(s.split())).lower()


def _open(token: str) -> bool:
    """Whether a sentence may go on after a token with a mark at its end: abbreviation, initial, number cut at its point, quoted question."""
    core = token.rstrip(CLOSERS)
    if core[-1:] in ("?", "!"):
        return core != token
    if core[-1:] != ".":
        return False
    core = core[:-1].lstrip(OPENERS)
    return len(core) <= 3 or "." in core or core.lower() in ABBREVIATIONS or bool(NUMBER.match(core))


def _trailing(line: str) -> str:
    """The sentence that a line lets trail off."""
    return _shape(LAST_STOP.split(line.rstrip(CLOSERS).rstrip("."))[-1])


def _grams(tokens: list[str], at: int) -> list[str]:
    """Keys of the token at a place with two, one and no tokens before it; numbers and names are alike."""
    t = [DIGITS.sub("0", x) for x in tokens[max(0, at - 2) : at + 1]]
    return ["p:" + " ".join(t[-n:]) for n in (3, 2, 1) if len(t) >= n]


def _line_key(line: str) -> str:
    """The end of a list item or heading: its last three words, or its last characters where words aren't spaced.

    Items that read as clauses (they begin in lower case or hold a semicolon) have keys of their own: that headings
    end with the same words says nothing about them.
    """
    s = _shape(line)
    item = BULLET.sub("", line, count=1)
    form = "l:; " if item[:1].islower() or SEMICOLON.search(item) else "l:"
    words = s.split(" ")
    if len(words) >= 4 or (s.isascii() and len(words) > 1):
        return form + " ".join(words[-3:])
    return form + s[-4:]


def _balanced(par: str) -> bool:
    if par.count('"') % 2 or par.count("**") % 2 or par.count("«") > par.count("»") or par.count("「") > par.count("」") or par.count("『") > par.count("』"):
        return False
    if "„" in par:
        if par.count("„") > par.count("“") + par.count("”"):
            return False
    elif par.count("“") > par.count("”"):
        return False
    return par.count("(") <= par.count(")") and par.count("（") <= par.count("）")


def ending(text: str | None) -> tuple[str, list[str]]:
    """('whole' | 'cut' | 'ask', keys): whether a value breaks off, or the evidence that decides it."""
    if text is None or not text.strip() or text.lstrip().startswith("[") and NOTE.match(text) and not MARKER.match(text):
        return "whole", []
    if MARKER.search(text[-40:]):
        return "cut", []
    body = text.rstrip()
    if body.count("```") % 2:
        return "cut", []
    lines = body.split("\n")
    last = lines[-1]
    if CLOSING.search(last):
        return "whole", []
    if last.strip().startswith("```"):
        return "whole", []
    if last.lstrip().startswith("|"):
        block = []
        for x in reversed(lines):
            if not x.lstrip().startswith("|"):
                break
            block.append(x.strip())
        whole = last.endswith("|") and len(last.strip()) > 1 and last.count("|") == block[-1].count("|") and len(block) >= 3
        return ("whole" if whole else "cut"), []
    if not _balanced(last):
        return "cut", []
    bare = last.rstrip(CLOSERS + " ")
    if last.endswith(("...", "…")) and bare[-1:] == ".":
        trailing = _trailing(last)
        return ("ask", ["e:" + trailing]) if len(trailing) >= TRAILING else ("cut", [])
    if bare[-1:] and bare[-1] in FINAL:
        tokens = TOKEN.findall(last[-200:])
        if not tokens:
            return "whole", []
        if bare[-1] in ".!?" and _open(tokens[-1]):
            return "ask", _grams(tokens, len(tokens) - 1)
        return "whole", []
    if last.startswith("#"):
        return "ask", ["h:" + _shape(last)]
    if m := LISTED.match(last):
        return "ask", ["s:" + m[2].split()[-1]]
    if FIGURE.match(last):
        return "ask", ["f:" + _shape(last)]
    if BULLET.match(last):
        return "ask", [_line_key(last)]
    if last[-1] in ")）" and bare != last:
        i = max(last.rfind("("), last.rfind("（"))
        before = last[:i].rstrip()
        return ("whole" if i >= 0 and (not before or before.rstrip(CLOSERS)[-1:] in tuple(FINAL)) else "cut"), []
    if len(last) <= SHORT and len(last.split()) <= 6 and last.isprintable() and last[-1] not in ",;:" and not STOP.search(last):
        return "ask", ["r:" + _shape(last)]
    return "cut", []


def evidence(text: str, out: Counter, ends: Counter) -> None:
    """Counts, over what precedes the last line or sentence, of keys (``out``) and of those that were endings (``ends``)."""
    body = text.rstrip()
    lines = body.split("\n")
    for x in lines[:-1]:
        if x.startswith("#"):
            ends["h:" + _shape(x)] += 1
        elif FIGURE.match(x):
            ends["f:" + _shape(x)] += 1
        elif BULLET.match(x):
            ends[_line_key(x)] += 1
    last = lines[-1]
    if m := LISTED.match(last):
        for item in m[2].split()[:-1]:
            ends["s:" + item.rstrip(",")] += 1
    if len(last) <= SHORT and len(last.split()) <= 6 and last and not BULLET.match(last):
        ends["r:" + _shape(last)] += 1
    for m in STOP.finditer(body):
        tokens = body[max(0, m.start() - 60) : m.end()].split()[-3:]
        if _open(tokens[-1]):
            starts = _term(body, EVENT.match(body, m.start()))
            for g in _grams(tokens, len(tokens) - 1):
                (ends if starts is not None and starts - TERM & 4 else out)[g] += 1
    if last.endswith("...") and len(trailing := _trailing(last)) >= TRAILING:
        ends["e:" + trailing] += 1


TORN_KEY = re.compile(r'(\\?)"verdict\1"\s*:\s*')
TORN_TEXT = re.compile(r'(?:\{(?:[^{}]*?,)?\s*"text"\s*:\s*)?"(?:[^"\\]|\\.)*\\?\Z', re.S)


def torn(json: str) -> bool:
    """Whether unreadable JSON (perhaps encoded twice) breaks off inside the text of its verdict."""
    at = None
    for at in TORN_KEY.finditer(json):  # noqa: B007
        pass
    if at is None:
        return False
    rest = json[at.end() :]
    return bool(TORN_TEXT.match(re.sub(r"\\(.)", r"\1", rest, flags=re.S) if at[1] else rest))


ROWS = "field string, rec_id bigint, run_id bigint, chars int, bytes int, status string, keys array<string>, key string, n_end bigint, n_more bigint"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        more: Counter = Counter()
        ends: Counter = Counter()
        rows = []
        for field, rec, run, text, broken in zip(b.field, b.rec_id, b.run_id, b.text, b.broken, strict=True):
            if text is None:
                continue
            if broken:
                if torn(text):
                    rows.append((field, rec, run, None, None, "cut", []))
                continue
            status, keys = ending(text)
            rows.append((field, rec, run, len(text), len(text.encode("utf-8", "replace")), status, keys))
            evidence(text, more, ends)
        v = pd.DataFrame(rows, columns=["field", "rec_id", "run_id", "chars", "bytes", "status", "keys"])
        e = pd.DataFrame({"key": list(ends.keys() | more.keys())})
        e["n_end"] = [ends[k] for k in e.key]
        e["n_more"] = [more[k] for k in e.key]
        for part in (v, e):
            full = part.reindex(columns=["field", "rec_id", "run_id", "chars", "bytes", "status", "keys", "key", "n_end", "n_more"])
            for c in ("rec_id", "run_id", "n_end", "n_more"):
                full[c] = full[c].astype("Int64")
            for c in ("chars", "bytes"):
                full[c] = full[c].astype("Int32")
            for c in ("field", "status", "keys", "key"):
                full[c] = full[c].astype(object).where(full[c].notna(), None)
            yield full


def values(turns: DataFrame, run_events: DataFrame) -> DataFrame:
    """``field, rec_id, run_id, text, broken`` of every value; ``broken`` if the record itself ends inside it."""
    # the collections are named so that the schema isn't followed into them
    inside = [c for c in EVENT_COLLECTIONS if set(c.kinds) & {*VERDICT.kinds, *REASONING.kinds}]
    nested = NestedTables(run_events, "event_id", "event", "data", inside, [VERDICT, REASONING], carry=("run_id",), opaque=("converged",))
    said = turns.select(F.lit("turns.text").alias("field"), F.col("id").alias("rec_id"), "run_id", "text", F.lit(False).alias("broken"))

    def value(field: str, text: Column, broken: bool) -> Column:
        return F.struct(F.lit(field).alias("field"), text.alias("text"), F.lit(broken).alias("broken"))

    torn_text = F.when(F.col("kind").isin(list(VERDICT.kinds)), F.col("unreadable"))
    each = F.explode(F.array(value("data.verdict", F.col("verdict"), False), value("data.reasoning", F.col("reasoning"), False), value("data.verdict", torn_text, True)))
    held = nested.texts("run_id").select(F.col("rec").alias("rec_id"), "run_id", each.alias("x")).select("x.field", "rec_id", "run_id", "x.text", "x.broken")
    return said.unionByName(held)


class Truncation:
    """The operator over all values: limits, cut values, and the share cut of each source."""

    def __init__(self, turns: DataFrame, run_events: DataFrame, runs: DataFrame):
        got = values(turns, run_events).mapInPandas(_read, ROWS)
        self._all = cut(got)  # small rows, read several times below
        rows = self._all.filter("field is not null").select("field", "rec_id", "run_id", "chars", "bytes", "status", "keys").dropDuplicates(["field", "rec_id"])
        model = runs.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("run_id")).agg(F.max("model").alias("source"))
        self.sourced = cut(rows.join(model, "run_id", "left").withColumn("source", F.coalesce("source", F.lit(""))).drop("run_id"))

    def hazards(self) -> DataFrame:
        """``field, source, unit, length, n, n_torn, expected, p, significant`` of every length that occurs."""
        unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
        torn_ = (F.col("status") == "cut").cast("int").alias("torn")
        each = self.sourced.filter("chars > 0").select("field", "source", torn_, unit.alias("u")).select("field", "source", "torn", "u.*")
        counts = each.groupBy("field", "source", "unit", "length").agg(F.count("*").alias("n"), F.sum("torn").alias("n_torn"))
        # one row per distinct length: the windows' groups don't grow with the rows
        group = Window.partitionBy("field", "source", "unit")
        beyond = group.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
        near = group.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
        reach = counts.withColumn("reach", F.sum("n").over(beyond))
        seen = reach.withColumns({"n_near": F.sum("n").over(near) - F.col("n"), "reach_near": F.sum("reach").over(near) - F.col("reach"), "lengths": F.count("*").over(near) - 1})
        # lengths of the neighbourhood that don't occur have a hazard of 0: about as many are at risk as here
        at_risk = F.col("reach_near") + (F.lit(2 * NEIGHBOURS) - F.col("lengths")) * F.col("reach")
        expected = F.col("reach") * (F.col("n_near") + 0.5) / F.greatest(at_risk, F.lit(1))
        # upper bound of the Poisson tail P(X >= n), so the test errs on the safe side
        bound = F.when(F.col("n") > F.col("expected"), F.exp(F.col("n") - F.col("expected") - F.col("n") * F.ln(F.col("n") / F.col("expected")))).otherwise(F.lit(1.0))
        tested = seen.withColumn("expected", expected).withColumn("p", bound)
        tests = tested.agg(F.count("*").alias("tests"))  # one row
        # only a p up to the rate can pass, and its rank is the same among those alone: they are few, so one window ranks them
        small = tested.filter(F.col("p") <= FALSE_SHARE).crossJoin(F.broadcast(tests)).withColumn("rank", F.row_number().over(Window.orderBy("p", "field", "source", "unit", "length")))
        last = small.filter(F.col("p") <= FALSE_SHARE * F.col("rank") / F.col("tests")).agg(F.max("p").alias("last"))  # one row
        keep = F.coalesce(F.col("p") <= F.col("last"), F.lit(False)) & (F.col("n") >= LEAST) & (F.col("n") >= LEAST_RATIO * F.col("expected"))
        return tested.crossJoin(F.broadcast(last)).select("field", "source", "unit", "length", "n", "n_torn", "expected", "p", keep.alias("significant"))

    def at_limits(self) -> DataFrame:
        """``field, rec_id, source, by_itself``: every value, and at a significant length the odds that it ends there by itself, else null."""
        # a few lengths of each field and source; Catalyst chooses how to meet them
        odds = F.least((F.col("n") - F.col("n_torn") + HALF) / (F.col("n_torn") + HALF), F.lit(1.0))
        limits = self.hazards().filter("significant").select("field", "source", "unit", "length", odds.alias("odds"))
        by_chars = limits.filter("unit = 'chars'").select("field", "source", F.col("length").alias("chars"), F.col("odds").alias("at_chars"))
        by_bytes = limits.filter("unit = 'bytes'").select("field", "source", F.col("length").alias("bytes"), F.col("odds").alias("at_bytes"))
        met = self.sourced.join(by_chars, ["field", "source", "chars"], "left").join(by_bytes, ["field", "source", "bytes"], "left")
        return met.select("field", "rec_id", "source", "status", "keys", F.least("at_chars", "at_bytes").alias("by_itself"))

    def cut_values(self, by_hazard: bool = True) -> DataFrame:
        """``field, rec_id, source, cause`` of every cut value; cause is limit or transfer.

        Without ``by_hazard`` the odds of the lengths are left out (to see what they decide).
        """
        counts = self._all.filter("key is not null").groupBy("key").agg(F.sum("n_end").alias("n_end"), F.sum("n_more").alias("n_more"))
        # a remark that is the beginning of a far commoner one is that one, cut
        remarks = counts.filter(F.col("key").startswith("r:") & (F.col("n_end") >= SEEN))
        begun = remarks.select(F.explode(F.transform(F.sequence(F.lit(3), F.length("key") - 1), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key"), F.col("n_end").alias("n_longer"))
        begun = begun.groupBy(F.rtrim("key").alias("key")).agg(F.max("n_longer").alias("n_longer"))
        torn_remarks = remarks.join(begun, "key").filter("n_longer >= 2 * n_end").select("key")
        counts = counts.join(torn_remarks, "key", "left_anti")
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        placed = self.at_limits().filter("status in ('ask', 'cut')")
        asked = placed.filter("status = 'ask'").select("field", "rec_id", "source", "by_itself", F.posexplode("keys").alias("level", "key")).withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALT)).cast("int"))
        known = asked.join(salted, ["key", "salt"], "left").fillna(0, ["n_end", "n_more"])
        total = F.col("n_end") + F.col("n_more")
        enough = total >= F.when(F.substring("key", 1, 2).isin("p:", "r:", "e:"), SEEN).otherwise(1)
        best = known.groupBy("field", "rec_id", "source", "by_itself").agg(
            F.min_by(F.when(enough, (F.col("n_end") + HALF) / (total + 2 * HALF)), F.when(enough, F.col("level"))).alias("share"), F.max_by("key", "level").alias("least")
        )
        # nothing like it was seen: a point closes a sentence unless it is of an abbreviation that never does or of a torn number
        word = F.lower(F.regexp_replace(F.substring_index(F.expr("substring(least, 3)"), " ", -1), r"^[(\"“«„]+|[.)\"”»“]+$", ""))
        default = F.when(F.col("least").startswith("p:"), (~word.isin(sorted(ABBREVIATIONS - ENDING)) & ~word.rlike(r"\d") & ~word.rlike(r"^.$"))).otherwise(F.lit(False))
        share = F.coalesce("share", F.when(default, SURE).otherwise(1 - SURE))
        torn_off = share / (1 - share) * F.coalesce(F.col("by_itself") if by_hazard else F.lit(1.0), F.lit(1.0)) < ENDS / (1 - ENDS)
        open_cut = best.filter(torn_off).select("field", "rec_id", "source", "by_itself")
        found = placed.filter("status = 'cut'").select("field", "rec_id", "source", "by_itself").unionByName(open_cut)
        return found.select("field", "rec_id", "source", F.when(F.col("by_itself").isNotNull(), "limit").otherwise("transfer").alias("cause"))

    def limits(self) -> DataFrame:
        """The field limits: significant lengths at which most values are cut, with both counts."""
        cut_at = self.cut_values().filter("cause = 'limit'").join(self.sourced.select("field", "rec_id", "chars", "bytes"), ["field", "rec_id"])
        unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
        n_cut = cut_at.select("field", "source", unit.alias("u")).groupBy("field", "source", F.col("u.unit").alias("unit"), F.col("u.length").alias("length")).agg(F.count("*").alias("n_cut"))
        sure = self.hazards().filter("significant").join(n_cut, ["field", "source", "unit", "length"])
        return sure.filter(F.col("n_cut") * 2 >= F.col("n")).select("field", "source", "unit", "length", "n", "n_cut")

    def found(self) -> DataFrame:
        return self.cut_values().select("field", "rec_id").distinct()

    def report(self) -> DataFrame:
        """How often each source truncates: ``source, n_values, n_cut, n_limit, share_cut``."""
        total = self.sourced.filter("chars > 0 or status = 'cut'").groupBy("source").agg(F.count("*").alias("n_values"))
        lost = self.cut_values().distinct().groupBy("source").agg(F.count("*").alias("n_cut"), F.count_if(F.col("cause") == "limit").alias("n_limit"))
        return total.join(lost, "source", "left").fillna(0, ["n_cut", "n_limit"]).withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_values"), 6))
