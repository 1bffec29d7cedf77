"""JSON trees: differences by path, and typed values taken out of answers by field specifications.

Trees are VARIANT values; the walk over both trees is a fold within the row, level by level, so no tree is exploded over a shuffle.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16  #: deeper values are compared whole
SECRET = r"(?i)(api[_-]?key|secret|password|token)$"
MASK = "•••"


def _children(text: str) -> str:
    """SQL of a JSON text's children by key, as JSON texts: of an object its fields, of a list of objects with distinct string ids its
    elements by id; null for any other value."""
    tree = f"parse_json({text})"
    items = f"transform(try_variant_get({tree}, '$', 'array<variant>'), e -> to_json(e))"
    ids = "transform(l, e -> IF(schema_of_variant(try_variant_get(parse_json(e), '$.id', 'variant')) = 'STRING', try_variant_get(parse_json(e), '$.id', 'string'), NULL))"
    by_id = "size(l) > 0 AND forall(i, x -> x IS NOT NULL) AND size(array_distinct(i)) = size(l)"
    of_list = f"transform(array({items}), l -> transform(array({ids}), i -> IF({by_id}, map_from_arrays(i, l), NULL))[0])[0]"
    of_object = f"transform_values(try_variant_get({tree}, '$', 'map<string,variant>'), (k, v) -> coalesce(to_json(v), 'null'))"
    return f"CASE WHEN substr({text}, 1, 1) = '{{' THEN {of_object} WHEN substr({text}, 1, 1) = '[' THEN {of_list} END"


def _expand(x: str) -> str:
    """SQL of what a place (path and both texts) becomes a level further down: its children, or itself if it is to be compared."""
    path = f"concat({x}.path, '/', replace(replace(k, '~', '~0'), '/', '~1'))"
    place = lambda path, a, b, leaf: f"named_struct('path', {path}, 'a', {a}, 'b', {b}, 'leaf', {leaf})"
    children = f"transform(array_sort(array_union(map_keys(m.a), map_keys(m.b))), k -> {place(path, 'm.a[k]', 'm.b[k]', 'm.a[k] IS NULL OR m.b[k] IS NULL OR m.a[k] = m.b[k]')})"
    itself = f"array({place(f'{x}.path', f'{x}.a', f'{x}.b', 'true')})"
    both = f"m.a IS NOT NULL AND m.b IS NOT NULL AND substr({x}.a, 1, 1) = substr({x}.b, 1, 1)"
    return f"IF({x}.leaf, array({x}), flatten(transform(array(named_struct('a', {_children(f'{x}.a')}, 'b', {_children(f'{x}.b')})), m -> IF({both}, {children}, {itself}))))"


def json_changes(rows: DataFrame, key: str, before: str, after: str, levels: int = LEVELS, secret: str = SECRET) -> DataFrame:
    """(key, path, change, before, after) of what two JSON texts differ in: path is a JSON pointer, change is added, removed or changed.

    Objects are walked by their fields, lists of objects with distinct string ids by id; any other value is compared whole, and what
    stands on one side only is reported whole. Values under a secret name are masked. A null or malformed text is an empty object."""
    tree = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.lit("{}"))
    # a fold has the type of its start, so the start says that both texts may be missing
    start = "array(named_struct('path', '', 'a', nullif(a, ''), 'b', nullif(b, ''), 'leaf', a = b))"
    step = f"flatten(transform(found, x -> {_expand('x')}))"
    walked = rows.select(key, tree(before).alias("a"), tree(after).alias("b")).withColumn("found", F.expr(start))
    walked = walked.select(key, F.expr(f"aggregate(sequence(1, {levels}), found, (found, i) -> IF(exists(found, x -> NOT x.leaf), {step}, found))").alias("found"))
    each = walked.select(key, F.explode("found").alias("x")).select(key, "x.path", "x.a", "x.b")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    inner = rf'(?i)("[^"]*{secret.removeprefix("(?i)").rstrip("$")}"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\]]+)'
    hidden = F.substring_index("path", "/", -1).rlike(secret)
    masked = lambda c: F.when(F.col(c).isNotNull() & hidden, MASK).otherwise(F.regexp_replace(c, inner, f'$1"{MASK}"'))
    out = each.withColumn("change", change).where("change IS NOT NULL")
    return out.select(key, F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"), "change", masked("a").alias("before"), masked("b").alias("after"))


def change_labels(changes: DataFrame, key: str) -> DataFrame:
    """(key, labels): the areas that changed: a node of the pipeline, its wiring, or what else stands at the top."""
    parts = F.split(F.ltrim("path", F.lit("/")), "/")
    top = F.get(parts, F.lit(0))
    node = (top == "pipeline") & (F.get(parts, F.lit(1)) == "nodes") & F.get(parts, F.lit(2)).isNotNull()
    label = F.when(node, F.concat(F.lit("pipeline:"), F.get(parts, F.lit(2)))).when(top == "pipeline", "pipeline:(graph)").when(top == "", "/").otherwise(top)
    return changes.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))


# typed values -------------------------------------------------------------------------------------------------------------------

TYPES = {
    "string": "string", "text": "string", "enum": "string", "integer": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp_ntz",
    "keyword_list": "array<string>", "text_list": "array<string>", "integer_list": "array<bigint>", "float_list": "array<double>",
}


@dataclass(frozen=True)
class Field:
    """What an answer should hold under a name; an enum has its values, required fields are reported when they are missing."""

    name: str
    type: str
    values: tuple[str, ...] = ()
    required: bool = False
    instruction: str = ""

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"field {self.name}: unknown type {self.type}; known: {', '.join(TYPES)}")
        if self.values and self.type != "enum":
            raise ValueError(f"field {self.name}: only an enum has values")


def answer_schema(fields: list[Field]) -> dict:
    """The JSON schema that an answer must follow: each field may be null, nothing else may be there."""
    if len({f.name for f in fields}) != len(fields):
        raise ValueError("two fields have one name")
    kinds = {"integer": "integer", "float": "number", "bool": "boolean"}
    out = {}
    for f in fields:
        item = kinds.get(f.type.removesuffix("_list"), "string")
        node = {"type": ["array", "null"], "items": {"type": item}} if f.type.endswith("_list") else {"type": [item, "null"]}
        said = f.instruction
        if f.values:
            node["enum"] = [*f.values, None]
            said = f"{said} (one of: {', '.join(f.values)})".strip()
        out[f.name] = node | {"description": said}
    return {"type": "object", "properties": out, "required": list(out), "additionalProperties": False}


def _plain(of: Column) -> Column:
    return of.isNotNull() & ~of.startswith("OBJECT") & ~of.startswith("ARRAY") & (of != "VOID")


def _scalar(of: Column, text: Column, kind: str, values: tuple[str, ...] = ()) -> Column:
    """A value of the type from a variant's own type and its text; null if it is none."""
    said = F.nullif(F.trim(F.when(_plain(of), text)), F.lit(""))
    number = F.when(of != "BOOLEAN", said)
    if kind in ("integer", "integer_list"):
        whole = number.try_cast("decimal(38,6)")
        return F.when(whole == F.floor(whole), whole.try_cast("bigint"))
    if kind in ("float", "float_list"):
        real = number.try_cast("double")
        return F.when(~F.isnan(real) & (F.abs(real) < float("inf")), real)
    if kind == "bool":
        low = F.lower(said)
        return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    if kind == "datetime":
        return F.when((of == "STRING") & said.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"), said.try_cast("timestamp_ntz"))
    if kind == "enum" and values:
        return F.coalesce(*[F.when(F.lower(said) == x.lower(), x) for x in values])
    return said


def _element(kind: str):
    return lambda x: _scalar(F.schema_of_variant(x), F.try_variant_get(x, "$", "string"), kind)


def coerced(rows: DataFrame, answer: str, fields: list[Field], names: tuple[str, str] = ("values", "errors")) -> DataFrame:
    """rows with values and errors of a column of JSON answers: a struct of the fields' typed values, null where the answer has none or
    a wrong one, and an array of what is wrong. Elements of a list that do not fit are left out; a list of none is null. An
    answer that is no object has only that error. Each step is a projection of its own, so an answer is parsed once."""
    answer_schema(fields)
    own = rows.columns
    out = rows.withColumn("__tree", F.try_parse_json(answer))
    out = out.withColumn("__object", F.coalesce(F.schema_of_variant("__tree").startswith("OBJECT"), F.lit(False)))
    path = lambda f: "$['" + f.name.replace("'", "\\'") + "']"
    out = out.select(*own, "__object", *[F.when(F.col("__object"), F.try_variant_get("__tree", path(f), "variant")).alias(f"__v{i}") for i, f in enumerate(fields)])
    out = out.withColumns({f"__k{i}": F.schema_of_variant(f"__v{i}") for i in range(len(fields))} | {f"__t{i}": F.try_variant_get(f"__v{i}", "$", "array<variant>" if f.type.endswith("_list") else "string") for i, f in enumerate(fields)})
    typed = {}
    for i, f in enumerate(fields):
        if f.type.endswith("_list"):
            kept = F.array_compact(F.transform(f"__t{i}", _element(f.type)))
            typed[f"__x{i}"] = F.nullif(kept, F.array().cast(TYPES[f.type]))
        else:
            typed[f"__x{i}"] = _scalar(F.col(f"__k{i}"), F.col(f"__t{i}"), f.type, f.values).cast(TYPES[f.type])
    out = out.withColumns(typed)
    errors = []
    for i, f in enumerate(fields):
        given = F.coalesce(F.col(f"__k{i}") != "VOID", F.lit(False))
        wrong = F.when(given & F.col(f"__x{i}").isNull(), f"{f.name} is none of its values" if f.values else f"{f.name} is no {f.type}")
        errors.append(F.coalesce(wrong, F.when(~given, f"{f.name} is required") if f.required else F.lit(None).cast("string")))
    values = F.struct(*[F.col(f"__x{i}").alias(f.name) for i, f in enumerate(fields)])
    said = F.when(~F.col("__object"), F.array(F.lit("the answer is no object"))).otherwise(F.array_compact(F.array(*errors)))
    return out.select(*own, values.alias(names[0]), said.alias(names[1]))
