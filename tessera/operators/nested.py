"""Deeply nested semi-structured records into related flat tables.

The records arrive as JSON text in many shapes: fenced, encoded twice, wrapped in envelope objects, with
collections given as a list, as an object of named members, as a lone member or as encoded text, and with
null members. ``NestedTables`` infers a merged schema (one aggregation with map-side combine whose result is
a schema string, never rows), finds each wanted collection in it wherever envelopes put it, and explodes
every array level, carrying the parent's surrogate key and the ordinal.

Defined results: null, blank or unparsable text yields no rows; null members yield no rows but keep their
place; repeated input rows yield each item once; an empty table yields an empty table; columns of the input
other than the key, discriminator and JSON column are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import cut

FENCE = r"^(?U)\s*```\w*\s*|(?U)\s*```\s*$"
ENCODED = r"^\s*[\[{\"]"
BLANK = r"^(?U)\s*$"


@dataclass(frozen=True)
class Collection:
    """A first-level collection, and the collection inside each of its items.

    ``path`` is dotted and is matched as the end of an inferred path. ``child`` is the field of an item that
    holds the child collection; child items are scalars. ``kinds`` limits it to some record kinds.
    """

    entity: str
    path: str
    kinds: tuple[str, ...]
    child_entity: str | None = None
    child: str | None = None
    scalar: bool = False


@dataclass(frozen=True)
class Scalar:
    """A single value that becomes one row: ``text`` if non-blank, ``flag`` if it means true."""

    entity: str
    path: str
    kinds: tuple[str, ...]
    means: str


TRUE_WORDS = ("true", "yes", "y", "1", "t", "on")


def parse(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` with the record as VARIANT ``v``: fences stripped, a second encoding undone; null if it can't be read.

    Step by step, as each step uses the one before several times.
    """
    text = F.regexp_replace(F.col(json_col), FENCE, "")
    once = df.withColumn("t", text).withColumn("t", F.when(F.col("t").startswith('"'), F.regexp_replace(F.try_variant_get(F.try_parse_json("t"), "$", "string"), FENCE, "")).otherwise(F.col("t")))
    return once.withColumn("v", F.try_parse_json("t")).drop("t")


def _get(path: str) -> Column:
    """The value at a dotted path of the record; the record itself for an empty one."""
    if not path:
        return F.col("v")
    return F.try_variant_get("v", "$" + "".join(f"['{x}']" for x in path.split(".")), "variant")


def _decode(v: Column) -> Column:
    """A string variant holding JSON becomes what it encodes; anything else stays."""
    s = F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull() & F.try_variant_get(v, "$", "array<variant>").isNull(), F.try_variant_get(v, "$", "string"))
    s = F.regexp_replace(s, FENCE, "")
    return F.coalesce(F.when(s.rlike(ENCODED), F.try_parse_json(s)), v)


def members(v: Column, scalar: bool) -> Column:
    """``array<variant>`` of a collection in any of its shapes, in list or name order."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    obj = F.try_variant_get(v, "$", "map<string,variant>")
    named = F.transform(F.sort_array(F.map_keys(obj)), lambda k: obj[k])
    is_map = obj.isNotNull()
    if not scalar:  # an object with a scalar member is one item, not a collection of named ones
        is_map = is_map & F.forall(F.map_values(obj), lambda x: x.isNull() | F.is_variant_null(x) | F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
    return F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<variant>")).when(arr.isNotNull(), arr).when(is_map, named).otherwise(F.array(v))


class NestedTables:
    """The flat tables of one JSON column.

    ``carry`` names columns to keep, ``opaque`` paths known to hold nothing wanted, which the schema isn't
    followed into where records disagree about them.
    """

    def __init__(self, df: DataFrame, key: str, kind: str, json_col: str, collections: list[Collection], scalars: list[Scalar] = (), carry: tuple[str, ...] = (), opaque: tuple[str, ...] = ()):  # type: ignore[assignment]
        self.collections, self.scalars, self.opaque = list(collections), list(scalars), opaque
        kinds = sorted({k for c in [*self.collections, *self.scalars] for k in c.kinds})
        rows = (
            df.select(F.col(key).alias("rec"), *carry, F.lower(F.trim(F.col(kind))).alias("kind"), F.col(json_col).alias("json"))
            .filter(F.col("kind").isin(kinds) & F.col("json").isNotNull())
        )
        self._rows = parse(rows, "json")
        self.key = key
        self.paths = self._infer()

    def _infer(self) -> dict[str, list[tuple[str, str]]]:
        """kind -> [(dotted path, type)] of the merged schema, objects only descended.

        Where records disagree about a path (an object in some, a text in others) the merged type says only
        that; another round then merges the objects at that path alone. There are as many rounds as such
        disagreements are deep, one as a rule.
        """
        wanted = [*[c.path for c in [*self.collections, *self.scalars]], *self.opaque]
        found: dict[str, dict[str, str]] = {}
        todo, done = [""], set()
        while todo:
            at = [_get(p) for p in todo]
            aggs = [F.schema_of_variant_agg(F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v)).alias(f"s{i}") for i, v in enumerate(at)]
            # The result has one row per record kind and its size depends on the schema, not on the rows.
            merged = self._rows.filter(F.col("v").isNotNull()).groupBy("kind").agg(*aggs).collect()
            done.update(todo)
            more = set()
            for r in merged:
                for i, prefix in enumerate(todo):
                    for p, kind in _walk(r[f"s{i}"] or "VOID"):
                        path = f"{prefix}.{p}" if prefix else p
                        found.setdefault(r["kind"], {})[path] = kind
                        if kind == "VARIANT" and not any(path == w or path.endswith("." + w) for w in wanted):
                            more.add(path)
            todo = sorted(more - done)
        return {k: list(v.items()) for k, v in found.items()}

    def _at(self, spec: Collection | Scalar) -> Column:
        """The spec's value, wherever the merged schema of each record kind has it."""
        out = F.lit(None).cast("variant")
        others = [c.path for c in self.collections if c.path != spec.path]
        for kind in spec.kinds:
            found = [p for p, _ in self.paths.get(kind, []) if p == spec.path or p.endswith("." + spec.path)]
            found = [p for p in found if not any(f".{o}." in f".{p}" for o in others)]
            if found:
                at = F.coalesce(*[_get(p) for p in sorted(found, key=len)])
                out = F.when(F.col("kind") == kind, at).otherwise(out)
        return out

    def items(self) -> DataFrame:
        """Every item of every level in one pass over the records.

        Columns: ``rec`` (the record's key), ``entity``, ``parent_pos``, ``child_pos`` (0 at the first level),
        ``item_id`` and ``parent_id`` (surrogate keys; a first-level item's parent is its record), ``value`` (VARIANT).
        """
        first = [F.array().cast("array<struct<entity:string,pos:int,value:variant>>")]
        rows = self._rows
        for i, c in enumerate(self.collections):
            rows = rows.withColumn(f"c{i}", self._at(c)).withColumn(f"c{i}", _decode(F.col(f"c{i}")))
        for i, s in enumerate(self.scalars):
            rows = rows.withColumn(f"s{i}", self._at(s))
        for i, c in enumerate(self.collections):
            got = members(F.col(f"c{i}"), c.scalar)
            first.append(F.transform(got, _placed("pos", F.lit(c.entity).alias("entity"))))
        for i, s in enumerate(self.scalars):
            got = F.col(f"s{i}")
            first.append(F.when(_means(got, s.means), F.array(F.struct(F.lit(s.entity).alias("entity"), F.lit(0).alias("pos"), got.alias("value")))).otherwise(first[0]))
        one = rows.select("rec", F.explode(F.concat(*first)).alias("i")).select("rec", "i.*").filter(F.col("value").isNotNull() & (~F.is_variant_null("value") | (F.col("pos") == 0)))

        child = F.lit(None).cast("variant")
        name = F.lit(None).cast("string")
        for c in self.collections:
            if c.child:
                child = F.when(F.col("entity") == c.entity, F.try_variant_get("value", f"$['{c.child}']", "variant")).otherwise(child)
                name = F.when(F.col("entity") == c.entity, F.lit(c.child_entity)).otherwise(name)
        one = one.withColumn("child", child).withColumn("child", _decode(F.col("child")))
        below = F.transform(members(F.col("child"), True), _placed("child_pos"))
        self_ = F.array(F.struct(F.lit(0).alias("child_pos"), F.col("value")))
        two = one.select("rec", "entity", "pos", F.explode(F.concat(self_, below)).alias("j")).filter(F.col("j.value").isNotNull() & (~F.is_variant_null("j.value") | (F.col("pos") == 0)))
        at_child = F.col("j.child_pos") > 0
        me = F.concat_ws("/", "rec", "entity", "pos")
        return two.select(
            "rec",
            F.when(at_child, name).otherwise(F.col("entity")).alias("entity"),
            F.col("pos").alias("parent_pos"),
            F.col("j.child_pos").alias("child_pos"),
            F.when(at_child, F.concat_ws("/", me, "j.child_pos")).otherwise(me).alias("item_id"),
            F.when(at_child, me).otherwise(F.col("rec").cast("string")).alias("parent_id"),
            F.col("j.value").alias("value"),
        )

    def texts(self, *keep: str) -> DataFrame:
        """One row per record, in one pass: ``rec``, the kept columns, a text column for each scalar, and ``unreadable``.

        A scalar's text is that of its ``text`` member if it is an object; null if absent or of another kind of
        record. ``unreadable`` is the JSON of a record that can't be read whole, else null.
        """
        rows = self._rows.withColumns({f"at_{x.entity}": self._at(x) for x in self.scalars})
        out = [F.when(F.col("kind").isin(list(x.kinds)), _text(F.col(f"at_{x.entity}"))).alias(x.entity) for x in self.scalars]
        return rows.select("rec", *keep, "kind", *out, F.when(F.col("v").isNull(), F.col("json")).alias("unreadable"))

    def unreadable(self, kinds: tuple[str, ...], *keep: str) -> DataFrame:
        """``rec, json`` of the records of some kinds that can't be read whole."""
        return self._rows.filter(F.col("kind").isin(list(kinds)) & F.col("v").isNull()).select("rec", *keep, "json")

    def found(self) -> DataFrame:
        """One row per distinct item: key, entity, parent_pos, child_pos."""
        return self.items().select(F.col("rec").alias(self.key), "entity", "parent_pos", "child_pos").distinct()

    def flat(self, entity: str, fields: list[str]) -> DataFrame:
        """The flat table of one entity: keys, ordinals, and the named scalar fields as text.

        A scalar item's own value is in ``item``. Repeated records give each item once.
        """
        v = F.try_variant_get("value", "$", "string").alias("item")
        cols = [F.try_variant_get("value", f"$['{f}']", "string").alias(f) for f in fields] or [v]
        return self.items().filter(F.col("entity") == entity).select(F.col("rec").alias(self.key), "parent_id", "item_id", "parent_pos", "child_pos", *cols).dropDuplicates(["item_id"])


def _placed(name: str, *lead: Column):  # noqa: ANN202
    return lambda x, i: F.struct(*lead, (i + 1).cast("int").alias(name), x.alias("value"))


def _text(v: Column) -> Column:
    return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.try_variant_get(v, "$.text", "string")).otherwise(F.try_variant_get(v, "$", "string"))


def _means(v: Column, how: str) -> Column:
    text = _text(v)
    present = v.isNotNull() & ~F.is_variant_null(v)
    if how == "text":
        return F.coalesce(present & ~text.rlike(BLANK), F.lit(False))
    return F.coalesce(present & (F.lower(F.trim(text)).isin(*TRUE_WORDS) | (F.expr("try_cast(0 as double)") < F.abs(text.try_cast("double")))), F.lit(False))


def _walk(schema: str) -> Iterator[tuple[str, str]]:
    """Object paths of a merged-schema string, as (dotted path, type at it)."""
    pos = 0

    def kind(prefix: str) -> Iterator[tuple[str, str]]:
        nonlocal pos
        if not schema.startswith("OBJECT<", pos):
            depth, start = 0, pos
            while pos < len(schema) and not (depth == 0 and schema[pos] in ",>"):
                depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(schema[pos], 0)
                pos += 1
            yield prefix, schema[start:pos]
            return
        yield prefix, "OBJECT"
        pos += len("OBJECT<")
        while schema[pos] != ">":
            if schema[pos] == "`":
                end = schema.index("`", pos + 1)
                while schema[end + 1] == "`":
                    end = schema.index("`", end + 2)
                name, pos = schema[pos + 1 : end].replace("``", "`"), end + 1
            else:
                end = schema.index(":", pos)
                name, pos = schema[pos:end], end
            pos += len(": ")
            yield from kind(f"{prefix}.{name}" if prefix else name)
            if schema.startswith(", ", pos):
                pos += 2
        pos += 1

    yield from ((p, t) for p, t in kind("") if p)


def recursive_tables(df: DataFrame, key: str, json_col: str) -> tuple[DataFrame, DataFrame]:
    """Every array level of every record as a child table, whatever arrays there are: ``(items, fields)``.

    ``items``: ``rec, table, item_id, parent_id, ordinal``, a row per record (table ``$``) and per element of an array at
    any depth, named by the array's path; ``fields``: ``item_id, field, value``, the scalars of an item, those of objects
    inside it under dotted names. A round takes one level of objects and arrays apart, so there are as many rounds as
    records are deep; text that encodes JSON is taken apart like what it encodes, and null members give no rows.
    """
    rows = parse(df.select(F.col(key).alias("rec"), F.col(json_col).alias("json")).filter("json is not null").distinct(), "json").filter("v is not null")
    blank = F.lit(None).cast("string")
    now = rows.select("rec", F.lit("$").alias("table"), F.concat(F.col("rec").cast("string"), F.lit("/"), F.md5("json")).alias("item_id"), blank.alias("parent_id"), F.lit(0).alias("ordinal"), F.lit("").alias("prefix"), F.lit(True).alias("fresh"), "v")
    items = fields = None
    while True:
        now = cut(now)
        if now.isEmpty():
            break
        v = now.withColumn("v", _decode(F.col("v"))).withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), r"^(OBJECT|ARRAY)", 1))
        fresh = v.filter("fresh").select("rec", "table", "item_id", "parent_id", "ordinal")
        scalar = v.filter("kind = ''").select("item_id", F.when(F.col("prefix") == "", F.lit("item")).otherwise(F.col("prefix")).alias("field"), F.try_variant_get("v", "$", "string").alias("value"))
        items = fresh if items is None else items.unionByName(fresh)
        fields = scalar if fields is None else fields.unionByName(scalar)
        name = F.when(F.col("prefix") == "", F.col("k")).otherwise(F.concat_ws(".", "prefix", "k"))
        obj = v.filter("kind = 'OBJECT'").select("rec", "table", "item_id", "parent_id", "ordinal", "prefix", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "m"))
        arr = v.filter("kind = 'ARRAY'").select("rec", "table", "item_id", "prefix", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("n", "m"))
        inner = obj.select("rec", "table", "item_id", "parent_id", "ordinal", name.alias("prefix"), F.lit(False).alias("fresh"), F.col("m").alias("v"))
        path = F.when(F.col("prefix") == "", F.concat("table", F.lit("[]"))).otherwise(F.concat_ws(".", "table", "prefix"))
        below = arr.select("rec", path.alias("table"), F.concat_ws("/", "item_id", "prefix", (F.col("n") + 1).cast("string")).alias("item_id"), F.col("item_id").alias("parent_id"), (F.col("n") + 1).cast("int").alias("ordinal"), F.lit("").alias("prefix"), F.lit(True).alias("fresh"), F.col("m").alias("v"))
        now = inner.unionByName(below).filter(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    if items is None:
        none = df.sparkSession.createDataFrame([], "rec string, table string, item_id string, parent_id string, ordinal int")
        return none, df.sparkSession.createDataFrame([], "item_id string, field string, value string")
    return items, fields


#: The collections of the run events.
EVENT_COLLECTIONS = [
    Collection("plan_question", "plan.key_questions", ("planner",), "plan_kpi", "kpis"),
    Collection("question", "questions", ("judge",), "question_claim", "unsupported_claims"),
    Collection("judge_claim", "unsupported_claims", ("judge",), scalar=True),
    Collection("claim_review", "claim_reviews", ("news_verify",), "review_source", "sources"),
    Collection("resolution", "report.resolutions", ("review",), "anchor", "anchors"),
]
EVENT_SCALARS = [Scalar("verdict", "verdict", ("judge", "review"), "text"), Scalar("converged", "converged", ("judge",), "flag")]


def event_tables(run_events: DataFrame) -> NestedTables:
    return NestedTables(run_events, "event_id", "event", "data", EVENT_COLLECTIONS, EVENT_SCALARS)
