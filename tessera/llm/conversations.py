"""Conversations rebuilt from message rows.

The channel of a message is its run and its place is ``seq``. Redelivered messages are taken once, speaker
spellings become roles, and runs whose conversation is broken, empty or without reciprocal replies are told
apart. Inactivity gaps are calibrated over all messages and split a conversation into sessions; by the problem's
statement they don't make a run unsound, so they don't decide what ``unsound_runs`` lists.

Every grouping is by keys finer than a run first, so a run holding a third of all rows is spread over tasks.

Defined results: a message without a run belongs to no conversation; a null ``seq`` breaks its run; a null
text is blank; a null or unknown agent is no debater; repeated rows count once; an empty ``turns`` table makes
every run a case, an empty ``runs`` table every run of ``turns``. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEBATERS = ("bull", "bear", "judge")
BLANK = r"^(?U)\s*$"
NOTE = r"(?is)^(?U)\s*\[[^\[\]]*\bunavailable\b[^\[\]]*\]\s*$"
#: A gap is an inactivity if its logarithm lies this many scaled median deviations above the median.
GAP_DEVIATIONS = 6.0
LEAST_DEVIATION = 0.05


def squeeze(c: Column) -> Column:
    """Lower case without outer white space of any kind."""
    return F.lower(F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", ""))


def _keyed(turns: DataFrame) -> DataFrame:
    """The rows of runs with their role and the digest of their text."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return turns.filter(F.col("run_id").isNotNull()).select("run_id", "seq", squeeze(F.coalesce("agent", F.lit(""))).alias("role"), "round", "at", "text", digest.alias("digest"))


def messages(turns: DataFrame) -> DataFrame:
    """One row per message: ``run_id, seq, role, round, at, text``; redelivered ones taken once.

    A message is the same if run, seq, text and role are. The earliest ``at`` and lowest ``round`` stay.
    """
    return _keyed(turns).groupBy("run_id", "seq", "role", "digest").agg(F.min("round").alias("round"), F.min("at").alias("at"), F.max("text").alias("text"))


def soundness(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, sound, reason`` of every run named in either table; ``reason`` is null for a sound run.

    Texts are reduced to a digest and a mark before anything is shuffled.
    """
    debater = F.col("role").isin(*DEBATERS)
    text = F.coalesce(F.col("text"), F.lit(""))
    bad = F.coalesce(debater & (text.rlike(BLANK) | text.rlike(NOTE)), F.lit(False)).cast("int").alias("bad")
    light = _keyed(turns).select("run_id", "seq", "role", "round", F.unhex("digest").alias("digest"), bad)
    spread = light.repartition("run_id", "seq")  # both groupings below then need no further exchange
    said = spread.groupBy("run_id", "seq", "role", "digest").agg(F.min("round").alias("round"), F.max("bad").alias("bad"))
    bit = F.coalesce(*[F.when(F.col("role") == r, F.lit(1 << i)) for i, r in enumerate(DEBATERS)], F.lit(0))
    by_seq = said.groupBy("run_id", "seq").agg(F.count("*").alias("copies"), F.max("bad").alias("bad"), F.max("round").alias("round"), F.bit_or(bit).alias("roles"))
    by_round = by_seq.groupBy("run_id", "round").agg(
        F.count("*").alias("n"), F.count("seq").alias("n_seq"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.max("copies").alias("copies"), F.max("bad").alias("bad"), F.bit_or("roles").alias("roles")
    )
    whole = (1 << len(DEBATERS)) - 1
    by_run = by_round.groupBy("run_id").agg(
        F.sum("n").alias("n"), F.sum("n_seq").alias("n_seq"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("copies").alias("copies"), F.max("bad").alias("bad"),
        F.max(F.when(F.col("round").isNotNull(), (F.col("roles") != whole).cast("int"))).alias("unanswered"),
    )
    done = F.coalesce(squeeze(F.col("status")) == "done", F.lit(False))
    known = runs.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("run_id")).agg(F.min(done.cast("int")).alias("done"))
    reason = (
        F.when(F.col("done").isNull(), "no run")
        .when(F.col("done") == 0, "not done")
        .when(F.col("n").isNull(), "no turns")
        .when((F.col("copies") > 1) | (F.col("n_seq") < F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")), "broken order")
        .when(F.col("bad") == 1, "empty reply")
        .when(F.col("unanswered") == 1, "missing reply")
    )
    return known.join(by_run, "run_id", "full_outer").select("run_id", reason.isNull().alias("sound"), reason.alias("reason"))


def unsound_runs(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs to leave out, each once."""
    return soundness(turns, runs).filter(~F.col("sound")).select("run_id")


def gap_limit(turns: DataFrame) -> DataFrame:
    """One row, ``limit``: the logarithm of seconds above which a gap is an inactivity, from the light columns alone.

    The median of the gaps' logarithms and their median deviation come out of one pass over a histogram of logarithms
    in steps of a hundredth (about three thousand values at most, whatever the number of messages).
    """
    light = turns.filter("run_id is not null and seq is not null and at is not null").groupBy("run_id", "seq").agg(F.min("at").alias("at"))
    before = light.select("run_id", (F.col("seq") + 1).alias("seq"), F.col("at").alias("before"))
    log = F.ln((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / F.lit(1e6))
    bins = light.join(before, ["run_id", "seq"]).select(F.round(log, 2).alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    mid = bins.agg(F.percentile("x", F.lit(0.5), F.col("n")).alias("mid"))  # one row
    dev = bins.crossJoin(F.broadcast(mid)).agg(F.max("mid").alias("mid"), F.percentile(F.abs(F.col("x") - F.col("mid")), F.lit(0.5), F.col("n")).alias("dev"))  # one row
    return dev.select((F.col("mid") + GAP_DEVIATIONS * 1.4826 * F.greatest("dev", F.lit(LEAST_DEVIATION))).alias("limit"))


def conversations(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """The messages of the sound runs in order, with ``session``, counted up where a calibrated inactivity gap precedes.

    One row per message (run_id, session, seq, role, round, at, text, gap_s): a conversation of any length needs no
    task of its own for its texts. The predecessor is met by an equi-join on (run, seq), and the sessions are numbered
    over the few messages that begin one.
    """
    said = messages(turns).drop("digest").join(soundness(turns, runs).filter("sound").select("run_id"), "run_id", "left_semi")
    light = turns.filter("run_id is not null and seq is not null").groupBy("run_id", "seq").agg(F.min("at").alias("at"))
    before = light.select("run_id", (F.col("seq") + 1).alias("seq"), F.col("at").alias("before"))
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    steps = light.join(before, ["run_id", "seq"]).select("run_id", "seq", (gap / F.lit(1e6)).alias("gap_s")).crossJoin(F.broadcast(gap_limit(turns)))
    over = steps.filter(F.when(F.col("gap_s") > 0, F.ln("gap_s")) > F.col("limit"))
    begins = over.groupBy("run_id").agg(F.sort_array(F.collect_set("seq")).alias("begins"))  # the rare gaps of one run
    held = said.join(steps.select("run_id", "seq", "gap_s"), ["run_id", "seq"], "left").join(begins, "run_id", "left")
    session = F.coalesce(F.size(F.filter("begins", lambda b: b <= F.col("seq"))), F.lit(0)) + 1
    return held.select("run_id", F.when(F.col("begins").isNull(), 1).otherwise(session).alias("session"), "seq", "role", "round", "at", "text", "gap_s")


def replies(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, session, messages, roles, reciprocal``: of every session of the sound runs, whether two debaters speak in it."""
    said = conversations(turns, runs)
    spoke = F.collect_set(F.when(F.col("role").isin(*DEBATERS), F.col("role")))
    per = said.groupBy("run_id", "session").agg(F.count("*").alias("messages"), F.sort_array(spoke).alias("roles"))
    return per.withColumn("reciprocal", F.size("roles") >= 2)
