"""Document ids, keys, subjects and versions as Column -> Column functions. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def component_text(c: Column) -> Column:
    """Scalar to text: 5 and "5" agree, true is true, null is the text null."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def join_key(c: Column) -> Column:
    """Text-normalised join key; null stays null."""
    return c.cast("string")


def key_suffix(*cols: Column) -> Column:
    return F.to_json(F.array(*[component_text(c) for c in cols]))


def doc_id(table: str | Column, *cols: Column) -> Column:
    """``table:["c1","c2"]``."""
    t = F.lit(table) if isinstance(table, str) else table
    return F.concat(t, F.lit(":"), key_suffix(*cols))


def pk_key(*cols: Column) -> Column:
    """None: null; one: bare text; several: JSON array."""
    if not cols:
        return F.lit(None).cast("string")
    return component_text(cols[0]) if len(cols) == 1 else key_suffix(*cols)


def key_of(doc: Column, arity: int | None = None) -> Column:
    """Components of a document id: what follows the FIRST colon, as a JSON array; null if the arity differs."""
    at = F.locate(":", doc)
    parts = F.from_json(F.when(at > 0, F.substr(doc, at + 1)), "array<string>")
    return parts if arity is None else F.when(F.size(parts) == arity, parts)


def op_of(subject: Column) -> Column:
    return F.element_at(F.split(subject, "[.]"), -1)


def source_table(subject: Column, namespace: Column, relation: Column) -> Column:
    """Headers first, else segments 2 and 3 of a subject of four segments or more, else null."""
    seg = F.split(subject, "[.]")
    head = F.when(namespace.isNotNull() & relation.isNotNull(), F.concat_ws(".", namespace, relation))
    return F.coalesce(head, F.when(F.size(seg) >= 4, F.concat_ws(".", F.get(seg, 1), F.get(seg, 2))))


def sanitize_segment(c: Column) -> Column:
    """Each character outside [A-Za-z0-9_-] becomes _, empty becomes _."""
    return F.coalesce(F.nullif(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), F.lit("")), F.lit("_"))


def percent_encode(c: Column) -> Column:
    """RFC 3986 unreserved characters stay, other bytes become %HH."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def segment_encode(c: Column) -> Column:
    """Store key segment: [A-Za-z0-9-_.] stay, other bytes become %HH."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def segment_decode(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def valid_subject(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)*\z")


def valid_source_uri(c: Column) -> Column:
    return (F.length(c) > 0) & F.contains(c, F.lit("://"))


def valid_tenant(c: Column) -> Column:
    return c.rlike(r"\A[a-z0-9_-]{1,64}\z")


def valid_event(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9_-]{1,64}([.][A-Za-z0-9_-]{1,64})*\z")


def valid_entity(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9_-]{1,128}\z")


def text_mode(c: Column, kind: str) -> Column:
    """Top-level value in the text form of a change stream: t/f for booleans, JSON for nested values."""
    if kind == "boolean":
        return F.when(c, "t").when(~c, "f")
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    return c.cast("string")


def iso_to_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})", "$1 $2")


def datetime_text(ts: Column) -> Column:
    """Date only at midnight; T separator; microseconds only when there are any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.when((F.date_format(ts, "HH:mm:ss") == "00:00:00") & (micros == "000000"), F.date_format(ts, "yyyy-MM-dd")).when(micros == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def time_text(days: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """TIME with its days folded into hours."""
    return F.format_string("%02d:%02d:%02d", days * 24 + hours, minutes, seconds)


def source_version(*candidates: Column) -> Column:
    """The first present of the order headers, if digits: without leading zeros, zero is none."""
    first = F.coalesce(*candidates)
    digits = F.when(first.rlike(r"\A[0-9]+\z"), F.ltrim(first, F.lit("0")))
    return F.nullif(digits, F.lit("")).cast("decimal(20,0)")


def search_key(doc: Column) -> Column:
    """URL-safe base64 without padding; ids over 511 encoded bytes become h- and a digest."""
    enc = F.translate(F.rtrim(F.base64(doc.cast("binary")), F.lit("=")), "+/\r\n", "-_")
    return F.when(F.length(enc) > 511, F.concat(F.lit("h-"), F.sha2(doc.cast("binary"), 256))).otherwise(enc)


def index_segment(c: Column) -> Column:
    """Injective index name: _ is doubled, other bytes outside [A-Za-z0-9-] become _HH."""
    enc = F.replace(F.replace(F.replace(F.url_encode(F.replace(c, F.lit("_"), F.lit("~"))), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("."), F.lit("%2E"))
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("__")), F.lit("%"), F.lit("_"))


def record_id(doc: Column, fixed: bool = False) -> Column:
    """Components of a record id: the suffix's JSON array, else the suffix; with fixed routing the whole id."""
    if fixed:
        return F.array(doc)
    at = F.locate(":", doc)
    sfx = F.when(at > 0, F.substr(doc, at + 1)).otherwise(doc)
    return F.when(sfx.rlike(r"\A\[.*\]\z"), F.from_json(sfx, "array<string>")).otherwise(F.array(sfx))


def data_key(prefix: str, target: Column, doc: Column) -> Column:
    """``prefix:{target}:doc`` with the target as hash tag."""
    return F.concat(F.lit(f"{prefix}:{{"), segment_encode(target), F.lit("}:"), segment_encode(doc))


def lookup_field(path: str) -> str:
    return "_lx_" + path.replace(".", "_")


def cursor(c: Column) -> Column:
    """Wire cursor -> struct(kind, ms, seq); a bare decimal is the js kind; null if malformed."""
    js = F.regexp_extract(c, r"\A(?:js:)?([0-9]+)\z", 1)
    ms, seq = (F.regexp_extract(c, r"\Ars:([0-9]+)-([0-9]+)\z", i) for i in (1, 2))
    return F.when(js != "", F.struct(F.lit("js").alias("kind"), F.lit(0).cast("long").alias("ms"), js.try_cast("long").alias("seq"))).when(ms != "", F.struct(F.lit("rs").alias("kind"), ms.try_cast("long").alias("ms"), seq.try_cast("long").alias("seq")))


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob: * any run, ? one character, the rest literal."""
    import re

    return r"\A" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in glob) + r"\z"


def realtime_subject(tenant: Column, event: Column, entity: Column) -> Column:
    return F.concat_ws(".", F.lit("rt.t"), tenant, event, entity)


def parse_subject(subject: Column) -> Column:
    """struct(tenant, event, entity_id); the entity is the last segment (F32)."""
    seg = F.split(subject, "[.]")
    n = F.size(seg)
    return F.when(subject.startswith("rt.t.") & (n >= 5), F.struct(F.get(seg, 2).alias("tenant"), F.array_join(F.slice(seg, F.lit(4), F.greatest(n - 4, F.lit(0))), ".").alias("event"), F.element_at(seg, -1).alias("entity_id")))


def pointer_value(v: str, ptr: str, kind: str = "variant") -> str:
    """SQL for what an RFC 6901 pointer finds in a variant column: null if nothing. Digits are an array's index or a member's name."""
    from itertools import product

    parts = [p.replace("~1", "/").replace("~0", "~") for p in ptr.split("/")[1:]]
    name = lambda p: "['" + p.replace("'", "\\'") + "']"
    index = lambda p: p.isascii() and p.isdigit() and (p == "0" or p[0] != "0")
    paths = ["$" + "".join(c) for c in product(*([f"[{p}]", name(p)] if index(p) else [name(p)] for p in parts))]
    got = ['try_variant_get({}, "{}", "{}")'.format(v, p.replace("\\", "\\\\").replace('"', '\\"'), kind) for p in paths]
    return got[0] if len(got) == 1 else f"coalesce({', '.join(got)})"


def pointer(v: str, ptr: str) -> tuple[str, str]:
    """RFC 6901 pointer over a variant column: SQL for (value text, presence). A missing member differs from a null one."""
    return pointer_value(v, ptr, "string"), f"{pointer_value(v, ptr)} is not null"


def pointer_json(v: str, ptr: str) -> Column:
    """The JSON text of what a pointer finds; JSON null is the text null, nothing is null."""
    return F.to_json(F.expr(pointer_value(v, ptr)))


def json_value(x) -> Column:
    """The JSON text of a Python value, in the form that ``pointer_json`` has it."""
    import json

    return F.to_json(F.parse_json(F.lit(json.dumps(x))))


def json_order(c: Column) -> Column:
    """A sort key that compares scalars of one kind as values: nulls first."""
    return F.struct(c.isNotNull().alias("n"), c.alias("x"))


def project(have: list[str], wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [x for x in wanted if x in have]


def lookup_values(items: Column, name: str) -> Column:
    """Texts of one member of an array's elements, sorted: the values of a lookup field."""
    return F.array_sort(F.transform(items, lambda x: x[name].cast("string")))


def label_table(label: Column, names: dict[str, str] | None = None) -> Column:
    """The table of a label: a given name, else the label in lower case."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), label) if names else F.lit(None).cast("string")
    return F.coalesce(known, F.lower(label))


def index_name(template: str, subject: Column, at: Column, headers: dict[str, Column]) -> Column:
    """%Y %m %d %H %%, ${subject}, ${subject:N}, ${header:NAME}; substitutions are lower-cased and sanitised.

    An empty name and one that begins with _, - or + is an error of the run."""
    import re

    clean = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9_.\-]", "_")
    dates = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH"}
    parts: list[Column] = []
    for tok in re.findall(r"%[YmdH%]|\$\{[^}]*\}|[^%$]+|[%$]", template):
        if tok in dates:
            parts.append(F.date_format(at, dates[tok]))
        elif tok == "%%":
            parts.append(F.lit("%"))
        elif tok == "${subject}":
            parts.append(clean(subject))
        elif m := re.fullmatch(r"\$\{subject:(\d+)\}", tok):
            parts.append(clean(F.get(F.split(subject, "[.]"), int(m[1]))))
        elif m := re.fullmatch(r"\$\{header:(.+)\}", tok):
            parts.append(clean(headers[m[1]]))
        elif tok.startswith("${") or tok in "%$":
            raise ValueError(f"bad token {tok!r} in index template")
        else:
            parts.append(F.lit(tok))
    name = F.concat(*parts)
    bad = name.isNull() | (F.length(name) == 0) | name.rlike(r"\A[_\-+]")
    return F.when(bad, F.raise_error(F.concat(F.lit("bad index name "), F.coalesce(name, F.lit("null")))).cast("string")).otherwise(name)


def key_template(template: str, doc: Column, variant: str, headers: dict[str, Column]) -> Column:
    """View key: ${doc_id}, ${header:N}, ${json:/ptr}; null if a part is unresolved; needs doc_id or json."""
    import re

    if not re.search(r"\$\{(doc_id|json:)", template):
        raise ValueError("a view key needs ${doc_id} or ${json:...}")
    parts = []
    for tok in re.findall(r"\$\{[^}]*\}|[^$]+|\$", template):
        if tok == "${doc_id}":
            parts.append(doc)
        elif tok.startswith("${header:"):
            parts.append(headers[tok[9:-1]])
        elif tok.startswith("${json:"):
            parts.append(F.expr(pointer(variant, tok[7:-1])[0]))
        else:
            parts.append(F.lit(tok))
    return F.concat(*parts)


def expand(template: str, args: dict[str, str]) -> str:
    """{args.NAME} in a subject; an unterminated brace stays, an unknown argument is an error."""
    import re

    def one(m: re.Match) -> str:
        if m[1] not in args:
            raise KeyError(f"unknown argument {m[1]}")
        return str(args[m[1]])

    return re.sub(r"\{args\.([A-Za-z0-9_]+)\}", one, template)


def source_expression(expr: str, data: str, event: dict[str, Column], args: dict[str, str]) -> Column:
    """$data.a.b (missing: null), $event.FIELD, {args.x} or a literal."""
    if expr.startswith("$data."):
        return F.get_json_object(F.col(data), "$." + expr[6:])
    if expr.startswith("$event."):
        return event[expr[7:]]
    return F.lit(expand(expr, args))


def parse_sort(spec: str) -> tuple[str, bool]:
    """field, field:asc or field:desc -> (field, descending)."""
    field, _, way = spec.partition(":")
    if not field or way not in ("", "asc", "desc"):
        raise ValueError(f"bad sort {spec!r}")
    return field, way == "desc"


def event_id(at: Column, *cols: Column) -> Column:
    """26 characters of Crockford's base 32 that sort by time: 48 bits of the milliseconds of ``at``, then 80 bits of a
    hash of the natural key, in place of random ones, so that a repeated run gives the same id (F37)."""
    digits = lambda c, base, n: F.lpad(F.translate(F.conv(c, base, 32), "ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHJKMNPQRSTVWXYZ"), n, "0")
    key = F.sha2(F.to_json(F.array(*[component_text(c) for c in cols])), 256)
    return F.concat(digits(F.unix_millis(at).cast("string"), 10, 10), digits(F.substring(key, 1, 10), 16, 8), digits(F.substring(key, 11, 10), 16, 8))
