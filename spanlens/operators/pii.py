"""Personal data: spans by priority, redaction, and counts without the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import STEP, bound, in_parts_sql, let_sql, pattern, quoted, spans_sql

#: Kinds and patterns, in order of priority; the flag is for letter case.
#: White space stands beside character classes, not in them, as `pattern` puts a class in its place.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]++@(?:(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|[A-Za-z0-9.-]+\n[A-Za-z0-9.-]*[A-Za-z]{2,})", False),
    ("cpf", r"(?:CPF\s*:?\s*)?\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", True),
    ("rg", r"(?:RG|Carteira de Identidade|Identidade|Registro Geral)\s*:?\s*[A-Z]{0,2}(?:-|\s)?[\d.]{5,15}-?\w?", True),
    ("nascimento", r"(?:data\s+de\s+)?nascimento\s*:?\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}", True),
    ("nascimento", r"nascid[oa]\s+em\s+\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}", True),
    ("cep", r"(?:CEP\s*:?\s*)?(?<!\d)\d{5}-\d{3}(?!\d)", True),
    ("telefone", r"(?:(?:\(\s*\+?\d{2,3}\s*\)|\+\d{2,3})(?:\s|-)*)?\(?(?<!\d)\d{2}\)?(?:\s|[.-])*(?:9(?:\s|\.)?)?\d{4}(?:\s|[.-])*\d{4}(?!\d)", False),
    ("endereco", r"\b(?:rua|r\.|av\.|avenida|alameda|travessa|pra[çc]a|estrada|rodovia)\s+[^\n,]{3,60}(?:,\s*(?:n[º°.]?\s*)?\d{1,6})?(?:,\s*(?:apto?\.?|ap\.?|bloco|casa)[^\n,]{0,20})?", True),
    ("sexo", r"(?:sexo|g[êe]nero)\s*:?\s*(?:masculino|feminino|homem|mulher|m|f)\b\.?", True),
    ("estado-civil", r"(?:estado\s+civil\s*:?\s*)?\b(?:solteir[oa]|casad[oa]|divorciad[oa]|vi[úu]v[oa]|separad[oa]|uni[ãa]o\s+est[áa]vel)\b", True),
    ("idade", r"(?:idade\s*:?\s*)?\b(?:1[6-9]|[2-9]\d)\s+anos\b(?!\s*(?:\d|e\s+\d|de|em|no|na|meses))", True),
)

#: What every match of a kind's patterns holds, so that most texts are spared the patterns: one
#: of some words in lower case, or (after the marker) a shape of digits, written as the patterns are.
SHAPE = "\x00"
HINTS = {
    "email": ("@",),
    "cpf": (SHAPE, r"\d{3}\.\d{3}\.\d{3}-\d\d"),
    "rg": ("rg", "identidade", "registro geral"),
    "nascimento": ("nasc",),
    "cep": (SHAPE, r"\d{5}-\d{3}"),
    "telefone": (SHAPE, r"\d{4}(?:\s|[.-])*\d{4}"),
    "endereco": ("rua", "r.", "av.", "avenida", "alameda", "travessa", "praça", "praca", "estrada", "rodovia"),
    "sexo": ("sexo", "gênero", "genero"),
    "estado-civil": ("solteir", "casad", "divorciad", "viúv", "viuv", "separad", "união", "uniao"),
    "idade": ("anos",),
}

#: A shape that every match holds beside one of the words.
SHAPES = {"rg": r"[\d.]{5}"}

#: What stands for a span in redacted text, and the kinds' names.
LABELS = {
    "email": "[E-MAIL]",
    "telefone": "[TELEFONE]",
    "cpf": "[CPF]",
    "rg": "[RG]",
    "cep": "[CEP]",
    "endereco": "[ENDEREÇO]",
    "nascimento": "[DATA DE NASCIMENTO]",
    "idade": "[IDADE]",
    "estado-civil": "[ESTADO CIVIL]",
    "sexo": "[SEXO]",
}
TITLES = {
    "email": "e-mail",
    "telefone": "telefone",
    "cpf": "CPF",
    "rg": "documento de identidade",
    "cep": "CEP",
    "endereco": "endereço",
    "nascimento": "data de nascimento",
    "idade": "idade",
    "estado-civil": "estado civil",
    "sexo": "sexo",
}

SPAN = "ARRAY<STRUCT<kind: STRING, idx: INT, quote: STRING>>"
_FOUND = "ARRAY<STRUCT<idx: INT, kind: STRING, quote: STRING>>"


def lookup(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


#: Letters that patterns without case take for others, and what lower case leaves as they are.
_ALIKE = ("\u017F\u0131\u0130\u212A", "siik")


def lowered_sql(text: str) -> str:
    """A text in the form in which hints are looked for."""
    for letter, plain in zip(*_ALIKE):
        text = f"replace({text}, '{letter}', '{plain}')"
    return f"lower({text})"


def hinted_sql(kind: str, low: str) -> str:
    """Whether a lowered text holds what every match of a kind holds; false only where nothing can match."""
    first, *rest = HINTS[kind]
    if first == SHAPE:
        return f"{low} RLIKE {quoted(pattern(rest[0], ignore_case=False))}"
    some = "(" + " OR ".join(f"contains({low}, '{word}')" for word in (first, *rest)) + ")"
    return f"({some} AND {low} RLIKE {quoted(SHAPES[kind])})" if kind in SHAPES else some


def _end(span: str) -> str:
    return f"({span}.idx + char_length({span}.quote))"


def _added_sql(taken: str, new: str) -> str:
    """``taken`` (disjoint, in order) with those of ``new`` that touch none of it, again in order.

    Where ``taken`` is long, a span is held only against the parts of it that lie around the span.
    """

    def clash(span: str, other: str) -> str:
        return f"{span}.idx < {_end(other)} AND {other}.idx < {_end(span)}"

    part = in_parts_sql(taken, lambda part, c: f"array(named_struct('c', {c}, 'idx', {part}[0].idx, 'end', {_end(f'element_at({part}, -1)')}))")
    near = f"n.idx < q.end AND q.idx < {_end('n')} AND exists(slice({taken}, q.c * {STEP} + 1, {STEP}), o -> {clash('n', 'o')})"
    by_part = let_sql("around", part, f"filter({new}, n -> NOT exists(around, q -> {near}))")
    kept = f"CASE WHEN size({taken}) <= {STEP} THEN filter({new}, n -> NOT exists({taken}, o -> {clash('n', 'o')})) ELSE {by_part} END"
    return f"CASE WHEN size({new}) = 0 THEN {taken} ELSE sort_array(concat({taken}, {kept})) END"


def pii_spans_sql(text: str) -> str:
    """`pii_spans` as SQL text."""

    def found(kind: str, rule: str, ignore: bool) -> str:
        tagged = f"transform({spans_sql(text, pattern(rule, ignore))}, m -> named_struct('idx', m.idx, 'kind', '{kind}', 'quote', m.quote))"
        return f"CASE WHEN {hinted_sql(kind, 'low')} THEN CAST({tagged} AS {_FOUND}) ELSE CAST(array() AS {_FOUND}) END"

    by_kind = let_sql("low", lowered_sql(text), "array(" + ", ".join(found(*p) for p in PATTERNS) + ")")
    taken = f"aggregate({by_kind}, CAST(array() AS {_FOUND}), (taken, new) -> CAST({_added_sql('taken', 'new')} AS {_FOUND}))"
    return f"CAST(transform(coalesce({taken}, CAST(array() AS {_FOUND})), m -> named_struct('kind', m.kind, 'idx', m.idx, 'quote', m.quote)) AS {SPAN})"


def replace_sql(text: str, found: str) -> str:
    """``text`` with each span of ``found`` (disjoint, in order) as the label of its kind, as SQL text."""
    labels = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in LABELS.items()) + ")"

    def before(i: str) -> str:  # where the span before ends
        return f"CASE WHEN {i} = 0 THEN 0 ELSE {_end(f'get({found}, {i} - 1)')} END"

    def cut(part: str, c: str) -> str:  # a part's own stretch of text, so that no place is far from its start
        first = f"{c} * {STEP}"
        last = _end(f"element_at({part}, -1)")
        own = f"named_struct('text', substring({text}, {before(first)} + 1, {last} - ({before(first)})), 'at', {before(first)})"
        piece = f"concat(substring(own.text, {before(f'{first} + i')} - own.at + 1, m.idx - ({before(f'{first} + i')})), {labels}[m.kind])"
        return let_sql("own", own, f"transform({part}, (m, i) -> {piece})")

    rest = f"substring({text}, {_end(f'element_at({found}, -1)')} + 1)"
    return f"CASE WHEN size({found}) = 0 THEN {text} ELSE concat(array_join({in_parts_sql(found, cut)}, ''), {rest}) END"


def pii_spans(text: Column) -> Column:
    """Spans in order of place; one that touches a span of higher priority is left out whole."""
    return bound(text, pii_spans_sql)


def redact(text: Column) -> Column:
    """``text`` with personal data replaced by labels."""
    return bound(text, lambda t: let_sql("found", pii_spans_sql(t), replace_sql(t, "found")))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, pii)``: redacted text and the spans that were taken out of it."""
    found = docs.select("doc_id", "text", pii_spans(F.col("text")).alias("pii"))
    return found.select("doc_id", F.expr(replace_sql("text", "pii")).alias("text"), "pii")


def pii_rows(redacted: DataFrame) -> DataFrame:
    """``(doc_id, kind, idx, len)``; the value itself is not kept."""
    rows = redacted.select("doc_id", F.explode("pii").alias("s"))
    return rows.select("doc_id", "s.kind", "s.idx", F.char_length("s.quote").alias("len"))


def pii_summary(rows: DataFrame) -> DataFrame:
    """``(doc_id, kind, n, first_idx)``, kinds in order of first appearance by ``first_idx``."""
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def pii_panel(rows: DataFrame) -> DataFrame:
    """What may be shown: title of the kind and how often, never the value."""
    return pii_summary(rows).select("doc_id", lookup(TITLES, F.col("kind")).alias("title"), "n")
