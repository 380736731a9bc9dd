"""Lines, headings, sections: a forward fill over lines, then islands of equal kind."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from spanlens.functions.text import SPACE, begins, collapse, let, lines_of, pattern, strip_accents, trim, words
from spanlens.operators.periods import has_period

#: The words that open a section, by kind in order of priority.
HEADINGS = (
    ("experiencia", "experiencias?|experiencia profissional|historico profissional|atuacao profissional|trajetoria|experience|work experience|employment"),
    ("formacao", "formacao|escolaridade|educacao|education|graduacao|academic"),
    ("competencias", "competencias|principais competencias|habilidades|conhecimentos|qualificacoes|skills|top skills|tecnologias"),
    ("idiomas", "idiomas?|linguas?|languages?"),
    ("certificacoes", "certificacoes|certificados?|certifications?|licenses|cursos|treinamentos|premios"),
    ("resumo", "resumo|sintese|sintese profissional|sumario|perfil|perfil profissional|objetivos?|about|summary|sobre mim"),
    ("contato", "contatos?|contact|dados pessoais|informacoes pessoais|informacoes de contato"),
)
HEADING_CHARS, HEADING_WORDS, NAME_WORDS = 60, 6, 6

_FIRST_WORDS = [re.match(r"[a-z]+(?!\?)", opening)[0] for _, openings in HEADINGS for opening in openings.split("|")]
#: What every heading begins with; letters beyond ASCII may stand for any.
COULD_OPEN = rf"(?i)\A(?:{SPACE}|[|·•—–-])*" + begins(_FIRST_WORDS, r"[^\x00-\x7F]")

#: Kinds in the order of output (contact is never put out) and their names.
SECTION_ORDER = ("header", "resumo", "experiencia", "formacao", "competencias", "certificacoes", "idiomas", "outros")
SECTION_LABEL = {
    "header": "Cabeçalho",
    "contato": "Contato",
    "resumo": "Resumo",
    "experiencia": "Experiência",
    "formacao": "Formação",
    "competencias": "Competências",
    "idiomas": "Idiomas",
    "certificacoes": "Certificações",
    "outros": "Outros",
}


def by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def so_far() -> WindowSpec:
    return by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def detect_heading(line: Column) -> Column:
    """The kind of section that a line opens; null for other lines."""
    any_kind = pattern(rf"\A({'|'.join(opening for _, opening in HEADINGS)})\b", ignore_case=False)

    def kind_of(bare: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, opening in reversed(HEADINGS):
            kind = F.when(bare.rlike(pattern(rf"\A({opening})\b", ignore_case=False)), name).otherwise(kind)
        return F.when(bare.rlike(any_kind), kind)

    def read(whole: Column) -> Column:
        shaped = F.char_length(whole).between(1, HEADING_CHARS) & ~whole.rlike(r"[,;.]\z") & (F.size(words(whole)) <= HEADING_WORDS)
        bare = F.regexp_replace(F.lower(strip_accents(whole)), "[|·•—–-]", " ")
        return F.when(shaped, let(collapse(F.regexp_replace(bare, pattern(r"[:.]+\s*$"), "")), kind_of))

    return F.when(line.rlike(COULD_OPEN), let(trim(line), read))


def is_headline(line: Column) -> Column:
    return line.rlike(r"[|][^|]*[|]")


def looks_like_name(line: Column) -> Column:
    def read(whole: Column) -> Column:
        shaped = F.char_length(whole).between(2, 60) & ~whole.rlike("[:;.0-9|]") & (F.size(words(whole)) <= NAME_WORDS)
        return F.when(shaped, detect_heading(whole).isNull()).otherwise(False)

    return let(trim(line), read)


def line_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line, start_off)``, lines from 0 with their place in the text."""
    rows = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    before = F.sum(F.char_length("line") + 1).over(by_line().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start_off", F.coalesce(before, F.lit(0)).cast("int"))


def identity_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``identity``: a name, the run of headlines right below it, and up to two lines after.

    A run of headlines without a name above is no identity block; the lines after
    end at a blank line, a heading, a period or a long line.
    """
    line = F.col("line")
    # names and tails matter only beside headlines
    near = F.lead(is_headline(line)).over(by_line()) | F.lag(is_headline(line), 1).over(by_line()) | F.lag(is_headline(line), 2).over(by_line())
    back = lambda c, n: F.coalesce(F.lag(c, n).over(by_line()), F.lit(False))
    ok = lambda short: F.when(F.char_length(short).between(1, 60), detect_heading(short).isNull() & ~has_period(short)).otherwise(False)
    rows = lines.withColumns({"head": is_headline(line), "near": F.coalesce(near, F.lit(False))})
    rows = rows.withColumns({"named": F.when(F.col("near"), looks_like_name(line)).otherwise(False), "tail_ok": F.when(F.col("near"), let(trim(line), ok)).otherwise(False)})
    rows = rows.withColumn("opens", F.col("head") & ~back("head", 1))
    # every line of a run, and what follows it, knows whether the run has a name
    rows = rows.withColumn("owned", F.when(F.col("opens"), back("named", 1)))
    rows = rows.withColumn("owned", F.coalesce(F.last("owned", ignorenulls=True).over(so_far()), F.lit(False)))
    first = ~F.col("head") & back("head", 1) & back("owned", 1) & F.col("tail_ok")
    second = back("head", 2) & ~back("head", 1) & back("owned", 2) & back("tail_ok", 1) & F.col("tail_ok")
    name = ~F.col("head") & F.col("named") & F.coalesce(F.lead("opens").over(by_line()), F.lit(False))
    rows = rows.withColumn("identity", (F.col("head") & F.col("owned")) | first | second | name)
    return rows.drop("head", "near", "named", "tail_ok", "opens", "owned")


def assign_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``kind``: that of the last heading so far; identity lines are contact data."""
    rows = identity_lines(lines).withColumn("heading", detect_heading(F.col("line")))
    filled = F.coalesce(F.last("heading", ignorenulls=True).over(so_far()), F.lit("header"))
    return rows.withColumn("kind", F.when(F.col("identity"), "contato").otherwise(filled)).drop("identity", "heading")


def assign_override(assigned: DataFrame, overrides: DataFrame) -> DataFrame:
    """Kinds replaced by ``overrides`` ``(doc_id, seq, from_line, to_line, kind)``; the last one wins."""
    hits = overrides.select("doc_id", "seq", F.explode(F.sequence(F.least("from_line", "to_line"), F.greatest("from_line", "to_line"))).alias("line_no"), F.col("kind").alias("new_kind"))
    last = hits.groupBy("doc_id", "line_no").agg(F.max_by("new_kind", "seq").alias("new_kind"))
    return assigned.join(last, ["doc_id", "line_no"], "left").withColumn("kind", F.coalesce("new_kind", "kind")).drop("new_kind")


def section_blocks(assigned: DataFrame) -> DataFrame:
    """``(doc_id, block_no, kind, from_line, to_line, text)``: runs of lines of one kind."""
    change = F.coalesce(F.lag("kind").over(by_line()) != F.col("kind"), F.lit(False)).cast("int")
    runs = assigned.withColumn("change", change).withColumn("block_no", F.sum("change").over(so_far()).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return runs.groupBy("doc_id", "block_no").agg(
        F.first("kind").alias("kind"), F.min("line_no").alias("from_line"), F.max("line_no").alias("to_line"), text.alias("text")
    )


def kind_text(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """``(doc_id, text)``: the blocks of some kinds, in order, a line break between them."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return blocks.where(F.col("kind").isin(kinds)).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))


def experience_text(blocks: DataFrame) -> DataFrame:
    return kind_text(blocks, ["experiencia"])


def split_sections(lines: DataFrame) -> DataFrame:
    """``(doc_id, section_no, kind, heading, text, start, stop)``: a section for each heading.

    The text has neither the heading nor identity lines and is trimmed; a leading
    part without heading is there only if it has text.
    """
    rows = identity_lines(lines).withColumn("opens", detect_heading(F.col("line")))
    rows = rows.withColumn("section_no", F.sum(F.col("opens").isNotNull().cast("int")).over(so_far()).cast("int"))
    body = F.when(F.col("opens").isNull() & ~F.col("identity"), F.struct("line_no", "line"))
    joined = trim(F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda s: s["line"]), "\n"))
    width = F.sum(F.char_length("line") + 1)
    found = rows.groupBy("doc_id", "section_no").agg(
        F.coalesce(F.max("opens"), F.lit("header")).alias("kind"),
        F.max(F.when(F.col("opens").isNotNull(), trim(F.col("line")))).alias("heading"),
        joined.alias("text"),
        F.min("start_off").alias("start"),
        (F.min("start_off") + width).cast("int").alias("stop"),
    )
    last = F.max("section_no").over(Window.partitionBy("doc_id")) == F.col("section_no")
    found = found.withColumn("stop", F.when(last, F.col("stop") - 1).otherwise(F.col("stop")))
    return found.where(F.col("heading").isNotNull() | (F.col("text") != ""))


def section_text(sections: DataFrame, kind: str) -> DataFrame:
    """``(doc_id, text)``: the texts of all sections of a kind that are not empty."""
    chosen = sections.where((F.col("kind") == kind) & (F.col("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("section_no", "text")))
    return chosen.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))
