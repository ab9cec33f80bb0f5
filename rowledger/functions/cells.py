"""Cells as column expressions: states, canonical text, keys, reference tokens, delimited formats and hashes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.catalog import Field

#: Explicit null, and how a literal tilde is written.
NULL_MARK, TILDE = "~", "%7E"
INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: Ranges of the integer types, as text: what they hold does not fit the narrower SQL types.
RANGES = {
    "int32": ("-2147483648", "2147483647"),
    "int64": ("-9223372036854775808", "9223372036854775807"),
    "uint32": ("0", "4294967295"),
    "uint64": ("0", "18446744073709551615"),
}
for _name, _like in (("sint32", "int32"), ("sfixed32", "int32"), ("sint64", "int64"), ("sfixed64", "int64"), ("fixed32", "uint32"), ("fixed64", "uint64")):
    RANGES[_name] = RANGES[_like]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: Spark repeats an expression wherever it is used inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: White space that number and boolean texts may have around them.
BLANK = " \t\n\x0b\f\r"


def typed(text: Column, kind: str) -> Column:
    """The number that a text of a numeric type stands for, null if it is none. Texts of the wrong shape never get to the
    cast: it would take further notations."""
    if kind in RANGES:
        low, high = RANGES[kind]
        sql = "decimal(20,0)" if high == RANGES["uint64"][1] else "bigint"
        n = F.when(text.rlike(INTEGER), F.trim(text, F.lit(BLANK)).try_cast(sql))
        return n if kind in ("int64", "sint64", "sfixed64") else let(n, lambda n: F.when(n.between(F.lit(low).cast(sql), F.lit(high).cast(sql)), n))
    n = F.when(text.rlike(NUMBER), F.trim(text, F.lit(BLANK)).try_cast("double"))
    return F.nullif(n, F.when(F.lower(text).contains("e") | (F.length(text) > 300), F.when(F.abs(n) == float("inf"), n)))


def canonicalize(text: Column, kind: str) -> Column:
    """Canonical text of a value of the type, null if it is none."""
    if kind == "bool":
        word = F.lower(F.trim(text, F.lit(BLANK)))
        return F.when(word.isin("true", "false"), word).when(text == "1", "true").when(text == "0", "false")
    if kind in RANGES:
        return typed(text, kind).cast("string")
    if kind in ("float", "double"):
        return let(typed(text, kind), double_text)
    return text


def double_text(value: Column) -> Column:
    """Round-trip text of a double: plain from 1E-4 up to 1E15, else d.dddE+dd, never with a closing `.0`."""
    return let(value.cast("string"), lambda s: _shown(s, value))


def _shown(s: Column, value: Column) -> Column:
    """double_text of a value and its text in Java's notation."""

    def scientific(s: Column) -> Column:
        mantissa, e = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).cast("int")
        sign = F.when(mantissa.startswith("-"), "-").otherwise("")
        digits = F.rtrim(F.translate(mantissa, "-.", ""), F.lit("0"))
        n = F.length(digits)
        whole = F.when(n <= e + 1, F.rpad(digits, e + 1, F.lit("0"))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
        power = F.concat(F.when(e < 0, "E-").otherwise("E+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        small = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), power)
        shown = F.when((e >= 0) & (e < 15), whole).when((e < 0) & (e >= -4), F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).otherwise(small)
        return F.concat(sign, shown)

    def shortest(s: Column) -> Column:
        # A text of more than 15 digits may not be the shortest one that reads back as the value.
        tries = [F.upper(F.format_string(f"%.{n}e", value)) for n in (14, 15)]
        found = F.coalesce(*[F.when(x.try_cast("double") == value, x) for x in tries], s)
        return F.when(F.length(F.translate(F.substring_index(s, "E", 1), "-.", "")) > 15, found).otherwise(s)

    trimmed = lambda s: F.when(s.endswith(".0"), F.substr(s, F.lit(1), F.length(s) - 2)).otherwise(s)
    rare = let(shortest(s), lambda s: F.when(s.contains("E"), scientific(s)).otherwise(trimmed(s)))
    return F.when((F.length(s) <= 16) & ~s.contains("E"), trimmed(s)).otherwise(rare)


def _steps(text: Column, formula: Column, field: Field, at: Callable[[str], Column], formats: dict | None = None) -> list[dict[str, Column]]:
    """The parts of a parsed cell, in steps that each use the parts before (by name) more than once. formats: what has a
    function `parse` (text to canonical text, null where it does not apply), by name."""
    blank = F.coalesce(text, F.lit("")) == ""
    has_formula = F.coalesce(formula, F.lit("")) != ""
    plain = field.format is None and field.shape == "scalar"
    shown = F.when(F.upper(text) == TILDE, NULL_MARK).otherwise(text) if field.type == "string" and field.shape == "scalar" else text
    value = at("value")
    numeric = plain and (field.type in RANGES or field.type in ("float", "double"))
    number = at("number") if numeric else F.when(value.rlike(NUMBER), value.try_cast("double"))
    read, legacy = [{"value": canonicalize(shown, field.type) if plain else canonical_json(shown)}], F.lit(False)
    if numeric:
        read = [{"number": typed(shown, field.type)}, {"value": at("number").cast("string")}]
    if numeric and field.type in ("float", "double"):
        read = [read[0], {"java": at("number").cast("string")}, {"value": _shown(at("java"), at("number"))}]
    if field.format is not None:
        known = [(formats or {})[n].parse(shown) for n in (field.format, *field.legacy)]
        read = [{"read": parse_with_legacy(*known)}]
        value, legacy = at("read")["value"], F.coalesce(at("read")["legacy"], F.lit(False))
    problems = [(value.isNull(), "cell.unparseable" if field.format is None else F.coalesce(at("read")["error"], F.lit("cell.unparseable")))]
    if field.enum and plain:
        problems.append((~value.isin([x for n, v in field.enum for x in (n, str(v))]), "cell.enum"))
    if field.min is not None:
        problems.append((F.coalesce(number < field.min, F.lit(False)), "cell.min"))
    if field.max is not None:
        problems.append((F.coalesce(number > field.max, F.lit(False)), "cell.max"))
    if field.regex is not None:
        problems.append((~value.rlike(field.regex), "cell.regex"))
    wrong = reduce(lambda w, p: w.when(p[0], p[1]), problems[1:], F.when(problems[0][0], problems[0][1]))
    state = F.when(blank & ~has_formula, "Missing").when(blank, "Invalid").when(text == NULL_MARK, "Null").when(at("wrong").isNotNull(), "Invalid").otherwise("Value")
    error = F.when(blank & has_formula, "cell.formula_without_value").when(~blank & (text != NULL_MARK), at("wrong"))
    if field.required:
        error = F.when(at("own").isin("Missing", "Null"), "cell.required").otherwise(error)
    defaulted = (at("own") == "Missing") & F.lit(field.default is not None)
    return [
        *read,
        {"wrong": wrong},
        {"own": state},
        {
            "state": F.when(defaulted, "Defaulted").otherwise(at("own")),
            "text": F.when(defaulted, F.lit(field.default)).when(at("own") == "Value", value),
            "raw_state": F.when(has_formula, "Value").otherwise(at("own")),
            "raw_text": F.when(has_formula, F.concat(F.lit("="), formula)).when(~blank, text),
            "error": error,
            "legacy": legacy & (at("own") == "Value"),
        },
    ]


#: Cells of a row that are parsed in one generated method: the JVM never compiles methods of more than 8,000 bytes of byte code, which
#: four cells pass. Rows of more cells are parsed so many at a time, see apart.
WIDE = 2



def apart(columns: dict[str, Column]) -> dict[str, Column]:
    """columns, of which the first is made by a lambda: this keeps their projection out of the generated method of its stage, as a stage of
    its own, whose code Spark cuts into small methods, and what follows begins another one."""
    first = next(iter(columns))
    return columns | {first: let(columns[first], lambda x: x)}


PARSED = ("state", "text", "raw_state", "raw_text", "error")


def parse_cell(text: Column, formula: Column, field: Field) -> Column:
    """struct<state, text, raw_state, raw_text, error> of a cell; parse_columns does whole rows in generated code.

    States: Missing, Defaulted, Null, Value, Invalid. A formula's raw side is the formula, its value the cached text.
    """
    done: dict[str, Column] = {}
    steps = len(_steps(text, formula, field, lambda name: F.lit(None).cast("string")))

    def step(i: int) -> Column:
        parts = _steps(text, formula, field, lambda name: done.get(name, F.lit(None).cast("string")))[i]
        if i == steps - 1:
            return F.struct(*[parts[p].alias(p) for p in PARSED])
        ((name, value),) = parts.items()

        def rest(x: Column) -> Column:
            done[name] = x
            return step(i + 1)

        return let(value, rest)

    return step(0)


def parse_columns(rows: DataFrame, cells: dict[str, tuple[Column, Column | None, Field]], formats: dict | None = None) -> DataFrame:
    """rows with a struct as of parse_cell, and `legacy`, for each name of cells (text, formula or null, field); formats:
    registered cell formats by name, which fields may declare.

    Each part is a column of its own in one projection after the other. Spark does not merge projections where that
    would repeat an expression that costs something, so every cell's texts are matched and cast once, in generated code.
    """
    kept, none = rows.columns, F.lit(None).cast("string")
    part = lambda name, p: f"__{name}__{p}"
    plans = {n: _steps(text, none if formula is None else formula, field, lambda p, n=n: F.col(part(n, p)), formats) for n, (text, formula, field) in cells.items()}
    names = list(plans)
    for group in (names[i : i + WIDE] for i in range(0, len(names), WIDE)):
        last = max(len(plans[n]) for n in group) - 1
        for i in range(last + 1):
            made = {part(n, p): c for n in group for p, c in (plans[n][i].items() if i < len(plans[n]) else ())}
            rows = rows.withColumns(apart(made) if i == last and len(names) > WIDE else made)
    made = [F.struct(*[F.col(part(n, p)).alias(p) for p in (*PARSED, "legacy")]).alias(n) for n in cells]
    return rows.select(*[c for c in kept if c not in cells], *made)


def display_value(state: Column, text: Column, raw: Column) -> Column:
    """Printable form of a value of any state."""
    return F.when(state == "Missing", "<missing>").when(state == "Defaulted", F.concat(F.lit("<default:"), F.coalesce(text, F.lit("")), F.lit(">"))).when(state == "Null", "<null>").when(state == "Value", F.coalesce(text, F.lit(""))).when(state == "Invalid", F.concat(F.lit("<invalid:"), F.coalesce(raw, F.lit("")), F.lit(">")))


def write_cell(state: Column, text: Column, write: Callable[[Column], Column] | None = None) -> Column:
    """Text of a canonical value, null for an invalid one: Missing is empty, Null the mark, a literal mark is escaped (only
    strings can hold one). write (as Format.write, of the canonical format, never a former one) turns the canonical text into
    what the cell holds; null where it cannot."""
    held = write(text) if write else F.coalesce(text, F.lit(""))
    return F.when(state == "Missing", "").when(state == "Null", NULL_MARK).when(state.isin("Value", "Defaulted"), F.when(held == NULL_MARK, TILDE).otherwise(held))


def write_columns(rows: DataFrame, cells: dict[str, tuple[Column, Column, Field]], formats: dict | None = None) -> DataFrame:
    """rows with, for each name of cells (state, canonical text, field), struct<text, error>: what the cell is to hold, written through the field's
    format where it declares one, and cell.unwritable for an invalid value or one that the format refuses."""
    made = {}
    for name, (state, text, field) in cells.items():
        made[name] = write_cell(state, text, (formats or {})[field.format].write if field.format else None)
    rows = rows.withColumns({f"__{n}": c for n, c in made.items()})
    out = [F.struct(F.col(f"__{n}").alias("text"), F.when(F.col(f"__{n}").isNull(), "cell.unwritable").alias("error")).alias(n) for n in made]
    return rows.select(*[c for c in rows.columns if c not in made and c not in {f"__{n}" for n in made}], *out)


def comparison_text(text: Column, formula: Column) -> Column:
    return F.coalesce(F.when(formula != "", F.concat(F.lit("="), formula)), text, F.lit(""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def encode_key(*parts: Column) -> Column:
    """Composite key of parts with their lengths in UTF-16 units in front; null if a part is null."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("|", *[F.concat(utf16_length(p).cast("string"), F.lit(":"), p) for p in parts]))


def decode_key(key: Column) -> Column:
    """The parts of a composite key, null if it is none: a fold that cuts one part off the front at a time."""
    units = F.encode(key, "UTF-16BE")  # two bytes a unit
    start = F.struct(units.alias("rest"), F.array().cast("array<string>").alias("parts"), F.lit(True).alias("ok"))

    def cut(state: Column, _: Column) -> Column:
        def head(text: Column) -> Column:
            digits = F.regexp_extract(text, r"^(0|[1-9]\d{0,9}):", 1)
            n, at = digits.try_cast("bigint"), 2 * (F.length(digits) + 1)
            value = F.substring(state["rest"], at + 1, (2 * n).cast("int"))
            after = F.substring(state["rest"], (at + 2 * n + 1).cast("int"), F.lit(2147483647))
            # A part must be all there and not end between the two halves of a character, and more must follow a bar.
            whole = n.isNotNull() & (n <= 1_000_000_000) & (F.octet_length(value) == 2 * n) & ~F.hex(F.substring(value, -2, 1)).rlike("^D[89AB]$")
            ended = (F.octet_length(after) == 0) | ((F.octet_length(after) > 2) & (F.hex(F.substring(after, 1, 2)) == "007C"))
            good = F.coalesce(whole & ended, F.lit(False))
            return F.when(good, F.struct(F.substring(after, 3, 2147483647).alias("rest"), F.concat(state["parts"], F.array(F.decode(F.when(good, value), "UTF-16BE"))).alias("parts"), F.lit(True).alias("ok"))).otherwise(F.struct(state["rest"].alias("rest"), state["parts"].alias("parts"), F.lit(False).alias("ok")))

        return F.when(state["ok"] & (F.octet_length(state["rest"]) > 0), let(F.decode(state["rest"], "UTF-16BE"), head)).otherwise(state)

    most = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split(key, ":")) - 1))
    done = F.aggregate(most, start, cut, lambda s: F.when(s["ok"] & (F.octet_length(s["rest"]) == 0), s["parts"]))
    return F.when(key != "", done)


def build_key(*cells: tuple[str, Column]) -> Column:
    """struct<key, error, field> of (name, parsed cell) in the order of the key's fields: the first one that is neither
    Value nor Defaulted is the error; without fields there is no key and no error."""
    if not cells:
        return F.struct(*[F.lit(None).cast("string").alias(n) for n in ("key", "error", "field")])
    bad = [~c["state"].isin("Value", "Defaulted") for _, c in cells]
    first = reduce(lambda w, x: w.when(x[0], x[1]), [(b, n) for b, (n, _) in zip(bad[1:], cells[1:], strict=True)], F.when(bad[0], cells[0][0]))
    state = reduce(lambda w, x: w.when(x[0], x[1]), [(b, F.lower(c["state"])) for b, (_, c) in zip(bad[1:], cells[1:], strict=True)], F.when(bad[0], F.lower(cells[0][1]["state"])))
    none_bad = ~reduce(lambda x, y: x | y, bad)
    return F.struct(F.when(none_bad, encode_key(*[c["text"] for _, c in cells])).alias("key"), F.concat(F.lit("key."), state).alias("error"), first.alias("field"))


def encode_ref(table_id: int, *parts: Column) -> Column:
    """Reference token table:part|part with everything but unreserved characters as %XX; null if a part is empty."""
    safe = [percent(p) for p in parts]
    full = reduce(lambda a, b: a & b, [F.coalesce(p, F.lit("")) != "" for p in parts])
    return F.when(full, F.concat(F.lit(f"{table_id}:"), F.concat_ws("|", *safe)))


def parse_ref(token: Column) -> Column:
    """struct<table_id, parts>, null if the token is none: a positive int32 without leading zeros, then parts of unreserved
    characters and %XX that are UTF-8 without control characters."""
    grammar = r"^[1-9]\d{0,9}:(?:[A-Za-z0-9._~-]|%[0-9A-Fa-f]{2})+(?:\|(?:[A-Za-z0-9._~-]|%[0-9A-Fa-f]{2})+)*\z"
    table = F.substring_index(token, ":", 1).try_cast("int")
    parts = F.transform(F.split(F.substring_index(token, ":", -1), r"\|"), F.try_url_decode)
    sound = F.forall(parts, lambda p: p.isNotNull() & ~p.rlike(r"[\x00-\x1f\x7f-\x9f]"))
    # Bytes that are no UTF-8 decode to the replacement character, which may also be meant.
    sound = sound & (~F.array_join(parts, "").contains("\ufffd") | F.upper(token).contains("%EF%BF%BD"))
    return F.when(token.rlike(grammar) & table.isNotNull() & sound, F.struct(table.alias("table_id"), parts.alias("parts")))


def ref_key(parsed: Column) -> Column:
    """The composite key that a parsed token (struct<table_id, parts>) names."""
    return F.when(parsed.isNotNull(), F.array_join(F.transform(parsed["parts"], lambda p: F.concat(utf16_length(p).cast("string"), F.lit(":"), p)), "|"))


def key_ref(table_id: Column, key: Column) -> Column:
    """The token of a row by its table and composite key; null if the key is none or has an empty part."""
    def token(parts: Column) -> Column:
        return F.when(F.forall(parts, lambda p: p != ""), F.concat(table_id.cast("string"), F.lit(":"), F.array_join(F.transform(parts, percent), "|")))

    return F.when(table_id > 0, let(decode_key(key), token))


def percent(text: Column) -> Column:
    """Everything but unreserved characters as %XX of its UTF-8 bytes."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def valid_guid(guid: Column) -> Column:
    return F.coalesce(guid.rlike(r"^[0-9a-f]{32}\z") & (guid != "0" * 32), F.lit(False))


def parse_identity(text: Column) -> Column:
    """struct<table_id, row_guid> of table:guid, null if it is none; the number may have a sign and blanks around it."""
    number, guid = F.trim(F.substring_index(text, ":", 1), F.lit(BLANK)), F.substr(text, F.locate(":", text) + 1)
    table = F.when(number.rlike(r"^[+-]?\d+\z"), number.try_cast("int"))
    return F.when(text.contains(":") & (table > 0) & valid_guid(guid), F.struct(table.alias("table_id"), guid.alias("row_guid")))


def valid_target(tag: Column) -> Column:
    return F.coalesce(tag.rlike(r"^[a-z][a-z0-9-]*\z"), F.lit(False))


def parse_revision(raw: Column) -> Column:
    """Revision, 0 where absent, null where it is no unsigned 32-bit number."""
    n = F.when(raw.rlike(r"^\d{1,10}\z"), raw.try_cast("bigint"))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(0).cast("bigint")).when(n <= 4294967295, n)


def split_delimited(text: Column, separator: str) -> Column:
    """Raw segments of a delimited text with quoted parts; null if a quote is left open. The separator goes in front
    of the text, so that an empty first segment is kept."""
    mark = "".join(f"\\{c}" if not c.isalnum() else c for c in separator)
    pattern = rf'{mark}((?:"(?:[^"]|"")*"|(?!{mark})[^"])*)'
    return F.when(F.pmod(F.regexp_count(text, F.lit('"')), F.lit(2)) == 0, F.regexp_extract_all(F.concat(F.lit(separator), text), F.lit(pattern), F.lit(1)))


def decode_atom(part: Column) -> Column:
    quoted = F.trim(part).rlike('^".*"$')
    inner = F.replace(F.regexp_replace(F.trim(part), '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.when(quoted, inner).otherwise(F.trim(part))


def encode_atom(text: Column, *separators: str) -> Column:
    needs = reduce(lambda a, s: a | text.contains(s), separators, (text == "") | text.contains('"') | (F.trim(text) != text))
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def parse_join_list(text: Column, separator: str, kind: str) -> Column:
    """Array of canonical texts: empty segments drop out, quoted empty ones stay; null if any is unparseable."""
    values = F.transform(F.filter(split_delimited(text, separator), lambda p: F.trim(p) != ""), lambda p: canonicalize(decode_atom(p), kind))
    return let(values, lambda vs: F.when(F.forall(vs, lambda v: v.isNotNull()), vs))


def write_join_list(values: Column, separator: str) -> Column:
    return F.array_join(F.transform(values, lambda v: encode_atom(v, separator)), separator)


def parse_join_map(text: Column, outer: str, inner: str, key_kind: str = "string", value_kind: str = "string") -> Column:
    """Map of canonical texts; null for a pair without two parts, an unparseable part or a key that repeats."""
    atom = lambda p, i, kind: canonicalize(decode_atom(F.get(p, F.lit(i))), kind)
    pairs = F.transform(F.filter(split_delimited(text, outer), lambda p: F.trim(p) != ""), lambda p: split_delimited(p, inner))
    entries = F.transform(pairs, lambda p: F.when((F.size(p) == 2) & F.forall(p, lambda x: F.trim(x) != ""), F.struct(atom(p, 0, key_kind).alias("key"), atom(p, 1, value_kind).alias("value"))))

    def checked(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        ok = F.forall(es, lambda e: e["key"].isNotNull() & e["value"].isNotNull()) & (F.size(F.array_distinct(keys)) == F.size(keys))
        return F.when(ok, es)

    return F.map_from_entries(let(entries, checked))


def write_join_map(values: Column, outer: str, inner: str) -> Column:
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.concat(encode_atom(e["key"], outer, inner), F.lit(inner), encode_atom(e["value"], outer, inner))), outer)


def _pairs(text: Column, outer: str, inner: str) -> Column:
    """Array of [key part, value part] of a text of pairs; a pair that is not two parts that hold something is null."""
    pairs = F.transform(F.filter(split_delimited(text, outer), lambda p: F.trim(p) != ""), lambda p: split_delimited(p, inner))
    return F.transform(pairs, lambda p: F.when((F.size(p) == 2) & F.forall(p, lambda x: F.trim(x) != ""), p))


def parse_named_map(text: Column, outer: str, inner: str, key_kind: str = "string", value_kind: str | Fields = "string", field: str | None = None, name: str | None = None) -> Column:
    """Map of canonical texts from key=value pairs, of any order. value_kind: a type, or the fields of a struct one layer down, which
    `field` separates: by position, or as name=value pairs where `name` separates names from values. Null for a pair without two parts, an
    unparseable part, a key that repeats, an unknown or repeated name, or too many positions."""

    def value(part: Column) -> Column:
        if isinstance(value_kind, str):
            return canonicalize(decode_atom(part), value_kind)
        whole = decode_atom(part)
        return parse_named_struct(whole, field, name, value_kind) if name else _positional(whole, field, None, value_kind)

    entries = F.transform(_pairs(text, outer, inner), lambda p: F.when(p.isNotNull(), F.struct(canonicalize(decode_atom(F.get(p, F.lit(0))), key_kind).alias("key"), value(F.get(p, F.lit(1))).alias("value"))))

    def checked(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        ok = F.forall(es, lambda e: e["key"].isNotNull() & e["value"].isNotNull()) & (F.size(F.array_distinct(keys)) == F.size(keys))
        return F.when(ok, es)

    return F.map_from_entries(let(entries, checked))


def write_named_map(values: Column, outer: str, inner: str, names: list[str] | None = None, field: str | None = None, name: str | None = None) -> Column:
    """Pairs in the order of keys, as parse_named_map reads them; names: the fields of struct values, which are quoted as a whole
    where they hold a separator of the map."""

    def text(v: Column) -> Column:
        if names is None:
            return v
        return write_named_struct(v, field, name, names) if name else _written(v, names, field, None)

    entries = F.transform(F.array_sort(F.map_keys(values)), lambda k: F.concat(encode_atom(k, outer, inner), F.lit(inner), encode_atom(text(F.try_element_at(values, k)), outer, inner)))
    return F.array_join(entries, outer)


Fields = dict[str, "str | dict[str, str]"]


def _positional(text: Column, separator: str, inner: str | None, fields: Fields) -> Column:
    def read(parts: Column) -> Column:
        out = [F.size(parts).alias("n")]
        for i, (name, kind) in enumerate(fields.items()):
            if isinstance(kind, dict) and inner is None:
                raise ValueError(f"{name} needs a separator of its own")
            part = F.get(parts, F.lit(i))
            blank = F.trim(F.coalesce(part, F.lit(""))) == ""
            value = _positional(part, inner, None, kind) if isinstance(kind, dict) else canonicalize(decode_atom(part), kind)
            out += [blank.alias(f"b{i}"), F.when(~blank, value).alias(f"v{i}")]
        return F.when(parts.isNotNull(), F.struct(*out))

    def checked(r: Column) -> Column:
        sound = reduce(lambda a, i: a & (r[f"b{i}"] | r[f"v{i}"].isNotNull()), range(len(fields)), r["n"] <= len(fields))
        return F.when(sound, F.struct(*[r[f"v{i}"].alias(name) for i, name in enumerate(fields)]))

    return let(let(split_delimited(text, separator), read), checked)


def parse_join_struct(text: Column, separator: str, fields: Fields, inner: str | None = None) -> Column:
    """Struct of canonical texts by position (fields: name to type, or to the fields of a struct one layer down, which
    `inner` separates); an empty part is absent; null for too many parts or an unparseable one."""
    return _positional(text, separator, inner, fields)


def parse_join_struct_list(text: Column, outer: str, inner: str, fields: dict[str, str]) -> Column:
    """Array of flat structs; empty elements drop out; null if any is unparseable."""
    values = F.transform(F.filter(split_delimited(text, outer), lambda p: F.trim(p) != ""), lambda p: _positional(p, inner, None, fields))
    return let(values, lambda vs: F.when(F.forall(vs, lambda v: v.isNotNull()), vs))


def _written(value: Column, fields: Fields | list[str], separator: str, inner: str | None, *around: str) -> Column:
    parts = []
    for name in fields:
        below = fields[name] if isinstance(fields, dict) else None
        text = _written(value[name], below, inner, None, separator) if isinstance(below, dict) else encode_atom(value[name], separator, *([inner] if inner else []), *around)
        parts.append(F.coalesce(text, F.lit("")))
    trimmed = let(F.array(*parts), lambda ps: F.slice(ps, F.lit(1), F.array_max(F.transform(ps, lambda p, i: F.when(p != "", i + 1).otherwise(0)))))
    return F.when(value.isNotNull(), F.array_join(trimmed, separator))


def write_join_struct(value: Column, separator: str, names: list[str] | Fields, inner: str | None = None) -> Column:
    """Parts by position, without absent ones at the end; names as fields of parse_join_struct where structs nest."""
    return _written(value, names, separator, inner)


def write_join_struct_list(values: Column, outer: str, inner: str, names: list[str]) -> Column:
    return F.array_join(F.transform(values, lambda v: _written(v, names, inner, None, outer)), outer)


def typed_value(text: Column, kind: str) -> Column:
    """Canonical text as a typed leaf."""
    types = {"bool": "boolean", "float": "double", "double": "double", "uint64": "decimal(20,0)", "fixed64": "decimal(20,0)"}
    return text.try_cast(types.get(kind, "bigint" if kind in RANGES else "string"))


def comparable_raw(raw: Column, base_raw: Column, value: Column, base_value: Column) -> Column:
    """What a merge compares of a cell, each side a struct<state, text>: the raw side, unless it is the base's while the
    effective value changed; then the value, Defaulted counted as Value. A formula always stays raw."""
    unchanged_value = value.eqNullSafe(base_value)
    formula = F.coalesce((raw["state"] == "Value") & raw["text"].startswith("="), F.lit(False))
    shown = F.struct(F.when(value["state"] == "Defaulted", "Value").otherwise(value["state"]).alias("state"), value["text"].alias("text"))
    return F.when(~raw.eqNullSafe(base_raw) | unchanged_value | formula, raw).otherwise(shown)


def parse_named_struct(text: Column, outer: str, inner: str, fields: dict[str, str]) -> Column:
    """Struct of canonical texts from name=value pairs; null for a name that is unknown or repeats, or an unparseable value."""
    def read(pairs: Column) -> Column:
        known = F.forall(F.map_keys(pairs), lambda k: k.isin(*fields))
        out = [F.struct(F.try_element_at(pairs, F.lit(n)).isNull().alias("b"), canonicalize(F.try_element_at(pairs, F.lit(n)), kind).alias("v")).alias(n) for n, kind in fields.items()]
        return F.when(known, F.struct(*out))

    def checked(r: Column) -> Column:
        sound = reduce(lambda a, b: a & b, [r[n]["b"] | r[n]["v"].isNotNull() for n in fields])
        return F.when(sound, F.struct(*[r[n]["v"].alias(n) for n in fields]))

    return let(let(parse_join_map(text, outer, inner), read), checked)


def write_named_struct(value: Column, outer: str, inner: str, names: list[str]) -> Column:
    """name=value pairs of the fields that are set, in the order of names."""
    parts = F.array(*[F.when(value[n].isNotNull(), F.concat(F.lit(n + inner), encode_atom(value[n], outer, inner))) for n in names])
    return F.when(value.isNotNull(), F.array_join(F.filter(parts, lambda p: p.isNotNull()), outer))


def parse_with_legacy(canonical: Column, *legacy: Column) -> Column:
    """struct<value, legacy, error> of a text that several formats read, each null where it fails."""
    read = F.filter(F.array(canonical, *legacy), lambda v: v.isNotNull())
    kinds = F.size(F.array_distinct(read))
    return F.struct(
        F.when(kinds == 1, F.get(read, F.lit(0))).alias("value"),
        (canonical.isNull() & (kinds == 1)).alias("legacy"),
        F.when(kinds == 0, "cell.unparseable").when(kinds > 1, "cell.ambiguous").alias("error"),
    )


def canonical_labels(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(labels, lambda x: F.trim(x) != "")))


def canonical_json(text: Column) -> Column:
    """Keys sorted at every level, no white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def row_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+$", "") for p in parts])


def business_hash(table_id: Column, revision: Column, cells: Column) -> Column:
    """SHA-256 of a row as its workbook holds it: table, revision, and its cells map<path, struct<text, formula>> in the
    order of paths, each as path, v or f, and comparison text, all with their lengths in front."""
    sized = lambda x: F.concat(utf16_length(x).cast("string"), F.lit(":"), x)
    entry = lambda e: F.concat(sized(e["key"]), F.when(F.coalesce(e["value"]["formula"], F.lit("")) != "", "f").otherwise("v"), sized(comparison_text(e["value"]["text"], e["value"]["formula"])))
    # Entries sort by path, which no two of them share; their structs hold no maps, so they can be compared.
    entries = F.transform(F.array_sort(F.map_keys(cells)), lambda k: F.struct(k.alias("key"), F.try_element_at(cells, k).alias("value")))
    return F.sha2(F.concat(sized(table_id.cast("string")), sized(revision.cast("string")), F.array_join(F.transform(entries, entry), "")), 256)


def row_hash(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, null apart from empty."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p, F.lit(";")), F.lit("-;")) for p in [p.cast("string") for p in parts]]), 256)
