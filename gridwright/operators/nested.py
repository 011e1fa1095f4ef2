"""JSON documents of any shape as rows, one for each value: (path, kind, number, text), and what follows from them:
equality with a tolerance at any depth, first captures of whole features, and contracts on documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects and arrays within each other; a document that is deeper is an error.
MOST_DEPTH = 64


def leaves(documents: DataFrame, keys: list[str], column: str = "document") -> DataFrame:
    """keys, path, kind, size, number, text of every value of JSON texts: objects and arrays themselves with their size, and what
    they hold. kind is object, array, number, text or null; true and false are the numbers 1 and 0, as comparisons take them.

    Each round opens one level of all documents. A text that is no JSON, or no text at all, has the kind `broken`."""
    parsed = documents.select(*keys, F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v"))
    done: DataFrame | None = None
    level = parsed
    for _ in range(MOST_DEPTH):
        shape = F.coalesce(F.schema_of_variant("v"), F.lit("BROKEN"))
        typed = level.withColumn("shape", shape)
        kind = F.when(F.col("shape").startswith("OBJECT"), "object").when(F.col("shape").startswith("ARRAY"), "array").when(F.col("shape") == "STRING", "text").when(F.col("shape") == "VOID", "null").when(F.col("shape") == "BROKEN", "broken").otherwise("number")
        typed = typed.select(*keys, "path", "v", kind.alias("kind"))
        inner = F.col("kind").isin("object", "array")
        number = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double"))
        # objects by their keys, arrays by their places
        entries = F.when(F.col("kind") == "array", F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), x.alias("v")))).when(
            F.col("kind") == "object", F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("v"))))
        opened = typed.withColumn("entries", entries)
        rows = opened.select(*keys, "path", "kind", F.size("entries").alias("size"), number.alias("number"), F.when(F.col("kind") == "text", F.try_variant_get("v", "$", "string")).alias("text"))
        rows = rows.withColumn("size", F.when(F.col("kind").isin("object", "array"), F.col("size")))
        done = rows if done is None else done.unionByName(rows)
        level = opened.filter(inner).select(*keys, "path", F.explode("entries").alias("e")).select(*keys, F.concat("path", "e.step").alias("path"), F.col("e.v").alias("v"))
        if level.isEmpty():
            return done
    raise ValueError(f"documents are nested deeper than {MOST_DEPTH}")


def _once(value: Column, use) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


_NODES = "array<struct<path:string,in_a:boolean,in_b:boolean,a:variant,b:variant>>"
_FOUND = "array<struct<path:string,problem:string>>"


def _opened(v: Column) -> Column:
    """kind, size, and the entries of an array or an object; a text that is no JSON has no variant."""
    items, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")

    def told(x: Column) -> Column:
        shape = F.coalesce(F.schema_of_variant(v), F.lit("BROKEN"))
        bare = F.when(shape == "STRING", "text").when(shape == "VOID", "null").when(shape == "BROKEN", "broken").otherwise("number")
        kind = F.when(x["items"].isNotNull(), "array").when(x["fields"].isNotNull(), "object").otherwise(bare)
        size = F.coalesce(F.when(x["items"].isNotNull(), F.size(x["items"])), F.when(x["fields"].isNotNull(), F.size(x["fields"])))
        return F.struct(kind.alias("kind"), size.alias("size"), x["items"].alias("items"), x["fields"].alias("fields"))

    return _once(F.struct(items.alias("items"), fields.alias("fields")), told)


def _unlike(pairs: Column) -> Column:
    """Pairs without those whose values write alike, which are equal to the bottom: keys of objects are sorted."""
    return F.filter(pairs, lambda n: ~(n["in_a"] & n["in_b"] & F.to_json(n["a"]).eqNullSafe(F.to_json(n["b"]))))


def _compared(n: Column, tolerance: float) -> Column:
    """problem of a pair of values, and the pairs of what they hold: by place in arrays, by key in objects, the rest one-sided."""
    none, no_fields = F.array().cast("array<variant>"), F.create_map().cast("map<string,variant>")

    def told(o: Column) -> Column:
        a, b = o["a"], o["b"]
        number = lambda v: F.try_variant_get(v, "$", "double")
        text = lambda v: F.try_variant_get(v, "$", "string")
        close = _once(F.struct(number(n["a"]).alias("x"), number(n["b"]).alias("y")), lambda p: (F.abs(p["x"] - p["y"]) <= tolerance) | (p["x"] == p["y"]))
        problem = (F.when(~n["in_b"], "missing").when(~n["in_a"], "unexpected").when(a["kind"] != b["kind"], "kind").when(~a["size"].eqNullSafe(b["size"]), "size")
            .when(a["kind"] == "number", F.when(~close, "number")).when((a["kind"] == "text") & ~text(n["a"]).eqNullSafe(text(n["b"])), "text"))
        pair = lambda path, x, y: F.struct(path.alias("path"), x.isNotNull().alias("in_a"), y.isNotNull().alias("in_b"), x.alias("a"), y.alias("b"))
        places = F.zip_with(F.coalesce(a["items"], none), F.coalesce(b["items"], none), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        held = F.transform(places, lambda e, i: pair(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), e["x"], e["y"]))
        both = F.map_zip_with(F.coalesce(a["fields"], no_fields), F.coalesce(b["fields"], no_fields), lambda k, x, y: F.struct(x.alias("x"), y.alias("y")))
        named = F.transform(F.map_entries(both), lambda e: pair(F.concat(n["path"], F.lit("."), e["key"]), e["value"]["x"], e["value"]["y"]))
        array, object_ = ((a[c].isNotNull() | b[c].isNotNull()) for c in ("items", "fields"))
        inner = F.when(array & object_, F.concat(held, named)).when(array, held).when(object_, named).otherwise(F.array().cast(_NODES))
        return F.struct(n["path"].alias("path"), problem.alias("problem"), _unlike(inner).alias("inner"))

    return _once(F.struct(_opened(n["a"]).alias("a"), _opened(n["b"]).alias("b")), told)


def differences(left: DataFrame, right: DataFrame, keys: list[str], column: str = "document", tolerance: float = 1e-6) -> DataFrame:
    """keys, path, problem where two tables of documents differ: missing, unexpected, kind, size, number or text.

    Numbers may differ by the tolerance, at any depth; keys of objects and lengths of arrays must be equal. Documents are
    joined by their keys whole, and a pair is compared level by level within its row; equal texts need no look."""
    a, b = (side.select(*keys, F.struct(F.col(column).alias("document")).alias(name)) for side, name in ((left, "a"), (right, "b")))
    both = a.join(b, keys, "full_outer").filter("a is null or b is null or not (a.document <=> b.document)")
    one = lambda c: F.try_parse_json(F.col(f"{c}.document"))
    root = F.array(F.struct(F.lit("$").alias("path"), F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"), one("a").alias("a"), one("b").alias("b")))
    # brackets bound the depth of a text
    brackets = lambda c: F.length(F.regexp_replace(F.coalesce(F.col(f"{c}.document").cast("string"), F.lit("")), r"[^\[{]+", ""))
    levels = F.sequence(F.lit(0), F.least(F.greatest(brackets("a"), brackets("b")), F.lit(MOST_DEPTH - 1)))

    def level(acc: Column, _: Column) -> Column:
        done = lambda x: F.struct(F.flatten(F.transform(x, lambda n: n["inner"])).alias("nodes"),
            F.concat(acc["found"], F.transform(F.filter(x, lambda n: n["problem"].isNotNull()), lambda n: F.struct(n["path"].alias("path"), n["problem"].alias("problem")))).alias("found"))
        return F.when(F.size(acc["nodes"]) == 0, acc).otherwise(_once(F.transform(acc["nodes"], lambda n: _compared(n, tolerance)), done))

    walked = F.aggregate(levels, F.struct(_unlike(root.cast(_NODES)).alias("nodes"), F.array().cast(_FOUND).alias("found")), level)
    deep = lambda x: F.when(F.size(x["nodes"]) > 0, F.raise_error(F.lit(f"documents are nested deeper than {MOST_DEPTH}")).cast(_FOUND)).otherwise(x["found"])
    # an inner explode would have its filter walk each pair again
    return both.select(*keys, F.explode_outer(_once(walked, deep)).alias("p")).select(*keys, "p.path", "p.problem").filter("problem is not null")


def first_documents(rows: DataFrame, key: str = "id", tolerance: float = 1e-6) -> DataFrame:
    """One row an id of rows(tile, page, id, document): the first by (tile, page), times, conflict (a later one differs)."""
    first = rows.groupBy(key).agg(F.min_by(F.struct("tile", "page", "document"), F.struct("tile", "page", "document")).alias("f"), F.count("*").alias("times")).select(key, "f.*", "times")
    again = rows.join(first.filter("times > 1").select(key, F.col("document").alias("kept")), key).filter("document <> kept")  # equal texts are equal documents
    numbered = again.select(key, "tile", "page", F.xxhash64("document").alias("which"), "document", "kept").distinct()
    keys = [key, "tile", "page", "which"]
    bad = differences(numbered.select(*keys, F.col("kept").alias("document")), numbered.select(*keys, "document"), keys, tolerance=tolerance)
    return first.join(bad.select(key).distinct().withColumn("conflict", F.lit(True)), key, "left").na.fill(False, ["conflict"])


# --- contracts -----------------------------------------------------------------------------------


def generic(path: Column) -> Column:
    """A path with all places in arrays left open."""
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def contract_violations(values: DataFrame, rules: list[tuple[str, str, str, list | None, bool]], sizes: list[tuple[str, int]] = (), distinct: list[str] = (), keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, path, problem of leaves(values) against rules.

    rules: (parent, child, kind, allowed values or None, required): every object whose open path is `parent` has that
    child of that kind (numbers are finite); sizes: (open path of arrays, their length); distinct: open paths whose texts must differ within a document."""
    spark = values.sparkSession
    table = spark.createDataFrame([(p, c, k, None if v is None else [str(x) for x in v], r) for p, c, k, v, r in rules], "parent string, child string, want string, allowed array<string>, required boolean")
    here = values.withColumn("open", generic(F.col("path")))
    shown = F.when(F.col("kind") == "number", F.when(F.col("number") == F.floor("number"), F.col("number").cast("long").cast("string")).otherwise(F.col("number").cast("string"))).otherwise(F.col("text"))
    found = here.select(*keys, F.col("path").alias("at"), "kind", "number", shown.alias("shown"))
    wanted = here.filter("kind = 'object'").join(F.broadcast(table), F.col("open") == F.col("parent")).select(*keys, F.concat("path", F.lit("."), "child").alias("at"), "want", "allowed", "required")  # a row a rule
    x = wanted.join(found, [*keys, "at"], "left")
    problem = (F.when(F.col("kind").isNull(), F.when(F.col("required"), "missing")).when(F.col("kind") != F.col("want"), F.concat(F.lit("not "), "want"))
        .when((F.col("kind") == "number") & (F.col("number").isNull() | F.isnan("number") | (F.abs("number") == float("inf"))), "not finite").when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("shown")), "value"))
    out = x.select(*keys, F.col("at").alias("path"), problem.alias("problem")).filter("problem is not null")
    if sizes:
        lengths = spark.createDataFrame(list(sizes), "open string, length int")
        out = out.unionByName(here.filter("kind = 'array'").join(F.broadcast(lengths), "open").filter("size <> length").select(*keys, "path", F.lit("length").alias("problem")))
    if distinct:
        texts = here.filter(F.col("open").isin(list(distinct))).groupBy(*keys, "open", "text").agg(F.count("*").alias("n")).filter("n > 1")
        out = out.unionByName(texts.select(*keys, F.col("open").alias("path"), F.lit("repeated").alias("problem")))
    broken = here.filter("path = '$' and kind <> 'object'").select(*keys, "path", F.lit("not object").alias("problem"))
    return out.unionByName(broken)
