"""Queries on text: cleaning, personal data, sections, scope, terms, repetition, layout, sources.

Inputs are whole tables (documents, conversations, pages) or text that is written
for every row of a table; the SQL knows from the columns what must be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions.text import spans, strip_accents
from spanlens.operators import buzzwords as bw
from spanlens.operators import clean, layout, limits, metrics, pii, repetition, scope, sections, stints, validate
from spanlens.plans.career import NOW_YM, REPEATED, answers, career_documents, table
from spanlens.plans.engine import Analysis
from spanlens.plans.interval_queries import PERIODS
from spanlens.sources import documents as sources


def _analysis(spark: SparkSession, sf_dir: str, keep: bool = False, unshipped: bool = False) -> Analysis:
    return Analysis(career_documents(spark, sf_dir, unshipped), NOW_YM, keep=keep)


# -- cleaning: a line for every order ---------------------------------------------------


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 8
    line = (
        F.when(k == 0, F.concat(F.lit("  Página "), n, F.lit(" de 9")))
        .when(k == 1, F.concat(F.lit("Curitiba, Parana, Brasil Responsavel pela operacao completa da unidade "), n))
        .when(k == 2, F.concat(F.lit("Fechei "), n, F.lit(" contas.Depois revi;Por fim")))
        .when(k == 3, F.concat(F.lit("Com J.Silva em "), n))
        .when(k == 4, F.lit("Campinas, SP"))
        .when(k == 5, F.lit("2/5"))
        .when(k == 6, F.concat(F.lit("Item "), n))
        .otherwise(F.lit("Campinas, sp, 3"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


def page_furniture(spark, sf_dir):
    return _raw_lines(spark, sf_dir).select("o_orderkey", clean.is_page_furniture(F.col("line")).alias("furniture"))


def glued_sentence(spark, sf_dir):
    return _raw_lines(spark, sf_dir).select("o_orderkey", clean.unglue_sentence(F.col("line")).alias("line"))


def location_split(spark, sf_dir):
    return _raw_lines(spark, sf_dir).select("o_orderkey", clean.split_location(F.col("line")).alias("line"))


def is_location(spark, sf_dir):
    return _raw_lines(spark, sf_dir).select("o_orderkey", clean.is_location(F.col("line")).alias("place"))


def clean_text(spark, sf_dir):
    """All lines of a customer as one text, cleaned."""
    rows = _raw_lines(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    texts = rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda s: s["line"]), "\n").alias("text"))
    return texts.select("doc_id", clean.clean_text(F.col("text")).alias("text"))


# -- personal data ----------------------------------------------------------------------


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text with personal data for every customer."""
    n = F.col("c_custkey")
    two, four = F.format_string("%02d", n % 90 + 10), F.format_string("%04d", n % 9000 + 1000)
    parts = [
        F.concat(F.lit("Fale com c"), n.cast("string"), F.lit("@example.com ou ("), two, F.lit(") 9"), four, F.lit("-"), four, F.lit(".")),
        F.when(n % 2 == 0, F.concat(F.lit("CPF: 1"), two, F.lit("."), F.lit("456.789-"), two)).otherwise("Nascida em 01/02/1990"),
        F.when(n % 3 == 0, F.concat(F.lit("CEP 3"), four, F.lit("-123"))).otherwise(F.concat(F.lit("Mora na Rua das Flores, "), (n % 90 + 10).cast("string"))),
        F.when(n % 5 == 0, "Sou casada e tenho 34 anos").otherwise("Tenho 12 anos de casa e 34 anos de estudo"),
        F.when(n % 7 == 0, "Sexo: feminino").otherwise("RG: 12.345.678-9"),
        F.when(n % 2 == 0, F.concat(F.lit("Ramal (31) 9"), four, F.lit("\u2009"), four)).otherwise(F.concat(F.lit("Ramal 31 9"), four, F.lit("\u202f"), four)),
    ]
    return table(spark, sf_dir, "customer").select(n.alias("doc_id"), F.concat_ws("\n", *parts).alias("text"))


def span_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans(F.col("text"), "[0-9]+")).alias("k", "s"))
    return rows.select("doc_id", "k", "s.idx", "s.quote")


def pii_spans(spark, sf_dir):
    return pii.pii_rows(pii.redact_documents(_personal(spark, sf_dir))).select("doc_id", "kind", "idx", "len")


def pii_redact(spark, sf_dir):
    return pii.redact_documents(_personal(spark, sf_dir)).select("doc_id", "text")


def pii_summary(spark, sf_dir):
    return pii.pii_summary(pii.pii_rows(pii.redact_documents(_personal(spark, sf_dir)))).select("doc_id", "kind", "n")


def pii_panel(spark, sf_dir):
    """All kinds in the documents table, by title; SQL has no form for the patterns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pii_panel(pii.pii_rows(pii.redact_documents(docs)))


# -- lines and sections -----------------------------------------------------------------


def detect_heading(spark, sf_dir):
    rows = sections.line_rows(_analysis(spark, sf_dir).redacted).withColumn("kind", sections.detect_heading(F.col("line")))
    return rows.where("kind IS NOT NULL").select("doc_id", "line_no", "kind")


def line_offsets(spark, sf_dir):
    return sections.line_rows(_analysis(spark, sf_dir).redacted).select("doc_id", "line_no", "start_off")


def identity_block(spark, sf_dir):
    rows = sections.identity_lines(sections.line_rows(_analysis(spark, sf_dir).redacted))
    return rows.where("identity").select("doc_id", "line_no")


def assign_lines(spark, sf_dir):
    return _analysis(spark, sf_dir).lines.select("doc_id", "line_no", "line", "kind")


def assign_override(spark, sf_dir):
    """Kinds of all lines after the overrides."""
    lines = _analysis(spark, sf_dir).lines
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    change = F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(0).alias("from_line"), F.lit(2).alias("to_line"), F.lit("header").alias("kind")), F.struct(F.lit(2).alias("seq"), F.lit(1).alias("from_line"), F.lit(1).alias("to_line"), F.lit("outros").alias("kind"))))
    overrides = docs.select("doc_id", change.alias("c")).select("doc_id", "c.*")
    return sections.assign_override(lines, overrides).select("doc_id", "line_no", "kind")


def section_blocks(spark, sf_dir):
    return _analysis(spark, sf_dir).blocks


def experience_text(spark, sf_dir):
    return _analysis(spark, sf_dir).experience


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.split_sections(sections.line_rows(_analysis(spark, sf_dir).redacted))


def split_sections(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "section_no", "kind", "heading", F.char_length("text").alias("n_chars"), "start", "stop")


def section_text(spark, sf_dir):
    return sections.section_text(_split(spark, sf_dir), "competencias")


def is_label_line(spark, sf_dir):
    rows = sections.line_rows(_analysis(spark, sf_dir).redacted)
    return rows.where(stints.is_label_line(F.col("line"))).select("doc_id", "line_no", "line")


def accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strip_accents(F.col("text")).alias("plain"))


# -- sentences, scope, terms, repetition, lengths -----------------------------------------


def sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(metrics.sentences(F.col("text"))).alias("k", "sentence"))
    return rows


def paragraphs(spark, sf_dir):
    rows = metrics.paragraphs(_analysis(spark, sf_dir).experience_lines)
    return rows.select("doc_id", "para_no", "text", "is_header")


def metric_answers(spark, sf_dir):
    found = _analysis(spark, sf_dir, keep=True).missing_metrics
    return metrics.metric_answers(found, answers(found)).select("doc_id", "ord", "answer")


def metric_questions(spark, sf_dir):
    return metrics.metric_questions(metrics.metric_cards(_analysis(spark, sf_dir, keep=True).missing_metrics))


def scope_axes(spark, sf_dir):
    lines = _analysis(spark, sf_dir).lines
    axes = F.array_join(scope.scope_axes(F.col("line"), strict=True), ",")
    return lines.select("doc_id", "line_no", axes.alias("axes")).where("axes <> ''")


def scope_evidence(spark, sf_dir):
    return _analysis(spark, sf_dir, keep=True).scope.select("doc_id", "status", "axis", "quote")


def scope_empty_axes(spark, sf_dir):
    return _analysis(spark, sf_dir, keep=True).empty_axes


def buzzwords(spark, sf_dir):
    return _analysis(spark, sf_dir).buzzwords.select("doc_id", "ord", "term", "quote", "idx")


def buzzword_line_counts(spark, sf_dir):
    return bw.buzzword_line_counts(_analysis(spark, sf_dir, unshipped=True).redacted)


def shared_shingles(spark, sf_dir):
    """Shingles that several documents share, over the whole table."""
    rows = table(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("doc_id"), F.col("doc_id").alias("sec"), F.coalesce("text", F.lit("")).alias("text"))
    return repetition.shingle_counts(repetition.shingles(repetition.tokens(rows))).select("shingle", "n_secs")


def repeated_lines(spark, sf_dir):
    return _analysis(spark, sf_dir, keep=True, unshipped=True).repeated


def char_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    return docs.unionByName(turns).select("kind", "id", "part", limits.char_count(F.col("text")).cast("long").alias("n"))


def length_check(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("field", F.when(F.col("turn") % 2 == 0, "headline").otherwise("about"))
    checked = limits.length_check(rows, "text", F.col("field"))
    return checked.select("conv_id", "turn", "length", "limit", "remaining", "fits")


# -- answers of models --------------------------------------------------------------------


def level_field_violations(spark, sf_dir):
    n = F.col("c_custkey")
    level = F.get(F.array(*[F.lit(x) for x in ("Júnior", "pleno", "SÊNIOR", "Especialista | Gestor", "")]), (n % 5).cast("int"))
    said = F.when(n % 2 == 0, F.concat(F.lit("**"), level, F.lit("** porque sim"))).otherwise(F.concat(level, F.lit(". Depois")))
    distance = F.when(n % 3 == 0, "DISTANCIA: um  degrau").when(n % 3 == 1, "Distância entre os dois: enorme").otherwise("")
    output = F.concat(F.lit("NIVEL_COMPROVADO: "), said, F.lit("\nNível prometido no texto: Gestor.\n"), distance)
    return validate.level_field_violations(table(spark, sf_dir, "customer").select(n.alias("doc_id"), output.alias("output")))


# -- sources ------------------------------------------------------------------------------


def source_size_guard(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", (F.octet_length("html").cast("long") * 5000).alias("length"))
    return sources.size_guard(pages, F.col("length"))


def load_text(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 4 == 0, " \n ").otherwise(F.concat(F.lit("Page 1 of 2\n"), F.col("c_name"))).alias("text"))
    return sources.load_text(raw)


def reject_no_text(spark, sf_dir):
    """The whole documents table by its own texts, and planted rows without text beside it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, "\n\t ").alias("text"))
    return sources.reject_no_text(docs.unionByName(planted))


def extract_fenced(spark, sf_dir):
    n, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    md = (
        F.when(k == 0, F.concat(F.lit("# Titulo\n```\ncorpo "), n, F.lit("\n\n```\nresto\n```\noutro\n```")))
        .when(k == 1, F.concat(F.lit("  sem cerca "), n, F.lit("\n")))
        .when(k == 2, F.concat(F.lit("antes\n```  \naberta "), n, F.lit("\nate o fim\n")))
        .otherwise(F.concat(F.lit("```js\nnao\n```\nsim "), n, F.lit("\n```")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", sources.extract_fenced(md).alias("body"))


# -- layout: a page for every order ---------------------------------------------------------


def _raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two columns of words; every third page has one, every fifth a title across."""
    orders = table(spark, sf_dir, "orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_no")
    pages = orders.select("o_orderkey", F.col("o_custkey").alias("doc_id"), page)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(pages, F.col("l_orderkey") == F.col("o_orderkey"))
    no, y = F.col("l_linenumber"), (700 - 20 * F.col("l_linenumber")).cast("double")

    def item(number, text, x, at, width, height, shape):
        transform = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(shape), F.lit(x), at)
        return F.struct(number.alias("item_no"), text.alias("str"), transform.alias("transform"), F.lit(width).alias("width"), height.alias("height"))

    none = F.lit(None).cast("double")
    left = item(no * 4, F.concat(F.lit("linha "), no.cast("string")), 50.0, y, 200.0, F.lit(10.0), 10.0)
    right_text = F.concat(F.lit("coluna "), no.cast("string"), F.when(no % 2 == 0, ".").otherwise(""))
    right = F.when(F.col("o_orderkey") % 3 != 0, item(no * 4 + 1, right_text, 350.0, y, 200.0, none, -10.0))
    title = F.when((no == 1) & (F.col("o_orderkey") % 5 == 0), item(no * 4 + 2, F.concat(F.lit("Titulo "), F.col("o_orderkey").cast("string")), 50.0, F.lit(720.0), 500.0, F.lit(0.0), 0.0))
    empty = item(no * 4 + 3, F.lit(None).cast("string"), 0.0, y, 1.0, none, 1.0)
    listed = F.explode(F.array_compact(F.array(left, right, title, empty)))
    return rows.select("doc_id", "page_no", "o_orderkey", listed.alias("i")).select("doc_id", "page_no", "o_orderkey", "i.*")


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = layout.normalize_items(_raw_items(spark, sf_dir))
    pages = items.select("doc_id", "page_no").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return items, pages


def items_normalize(spark, sf_dir):
    return _items(spark, sf_dir)[0]


def page_gutter(spark, sf_dir):
    return layout.page_gutter(*_items(spark, sf_dir))


def page_lines(spark, sf_dir):
    return layout.page_lines(*_items(spark, sf_dir)).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


def page_text(spark, sf_dir):
    return layout.page_text(*_items(spark, sf_dir))


def document_text(spark, sf_dir):
    return layout.document_text(layout.page_text(*_items(spark, sf_dir)))


QUERIES = {
    "source_size_guard": source_size_guard,
    "items_normalize": items_normalize,
    "load_text": load_text,
    "reject_no_text": reject_no_text,
    "extract_fenced": extract_fenced,
    "page_gutter": page_gutter,
    "page_lines": page_lines,
    "page_text": page_text,
    "document_text": document_text,
    "page_furniture": page_furniture,
    "glued_sentence": glued_sentence,
    "location_split": location_split,
    "is_location": is_location,
    "clean_text": clean_text,
    "span_scan": span_scan,
    "pii_spans": pii_spans,
    "pii_redact": pii_redact,
    "pii_summary": pii_summary,
    "pii_panel": pii_panel,
    "detect_heading": detect_heading,
    "line_offsets": line_offsets,
    "identity_block": identity_block,
    "assign_lines": assign_lines,
    "assign_override": assign_override,
    "section_blocks": section_blocks,
    "experience_text": experience_text,
    "split_sections": split_sections,
    "section_text": section_text,
    "is_label_line": is_label_line,
    "strip_accents": accents,
    "sentences": sentences,
    "paragraphs": paragraphs,
    "metric_answers": metric_answers,
    "metric_questions": metric_questions,
    "scope_axes": scope_axes,
    "scope_evidence": scope_evidence,
    "scope_empty_axes": scope_empty_axes,
    "buzzwords": buzzwords,
    "buzzword_line_counts": buzzword_line_counts,
    "shared_shingles": shared_shingles,
    "repeated_lines": repeated_lines,
    "char_count": char_count,
    "length_check": length_check,
    "level_field_violations": level_field_violations,
}

#: Lines of the rendered documents after redaction, with the kind each must get.
LINES = PERIODS + f"""
, who AS (SELECT c_custkey AS doc_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, c_nationkey AS nat FROM customer WHERE c_custkey IN (SELECT doc_id FROM p)),
said AS (
  SELECT doc_id, pos, k, l FROM (
    SELECT doc_id, pos, unnest([1, 2, 3, 4, 5]) AS k, unnest([company, role,
      CASE WHEN years_only THEN CAST(start_ym // 12 AS VARCHAR) || ' a ' || coalesce(CAST(end_ym // 12 AS VARCHAR), 'atual')
           ELSE lpad(CAST(start_ym % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST(start_ym // 12 AS VARCHAR) || ' - ' || coalesce(lpad(CAST(end_ym % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST(end_ym // 12 AS VARCHAR), 'atual') END,
      CASE o_orderkey % 4 WHEN 0 THEN 'Implantei o novo fluxo de pedidos e reduzi o prazo em ' || CAST(o_orderkey % 90 + 10 AS VARCHAR) || '%.' WHEN 1 THEN 'Coordenei a equipe de atendimento da regional durante todo o projeto.' WHEN 3 THEN 'Atendi clientes.' END,
      '']) AS l FROM st) WHERE l IS NOT NULL),
raw AS (
  SELECT doc_id, 0 AS a, 0 AS b, 0 AS c, seg || ' Silva' AS line, 'contato' AS kind FROM who
  UNION ALL SELECT doc_id, 1, 0, 0, 'Analista | ' || seg || ' | Nacao ' || CAST(nat AS VARCHAR), 'contato' FROM who
  UNION ALL SELECT doc_id, 2, 0, 0, 'Contato: [E-MAIL]', 'contato' FROM who
  UNION ALL SELECT doc_id, 3, 0, 0, '', 'contato' FROM who
  UNION ALL SELECT doc_id, 4, 0, 0, 'Resumo', 'resumo' FROM who
  UNION ALL SELECT doc_id, 5, 0, 0, CASE doc_id % 3 WHEN 0 THEN 'Profissional proativo com foco em resultados.' WHEN 1 THEN 'Liderei projetos de melhoria contínua com equipe de dados.' ELSE 'Atuo com dados.' END, 'resumo' FROM who
  UNION ALL SELECT doc_id, 6, 0, 0, '{REPEATED}', 'resumo' FROM who WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 7, 0, 0, '', 'resumo' FROM who
  UNION ALL SELECT doc_id, 8, 0, 0, 'Experiência', 'experiencia' FROM who
  UNION ALL SELECT doc_id, 9, pos, k, l, 'experiencia' FROM said
  UNION ALL SELECT doc_id, 10, 0, 0, 'Formação', 'formacao' FROM who
  UNION ALL SELECT doc_id, 11, 0, 0, 'Bacharel em Engenharia', 'formacao' FROM who
  UNION ALL SELECT doc_id, 12, 0, 0, '', 'formacao' FROM who
  UNION ALL SELECT doc_id, 13, 0, 0, 'Competências', 'competencias' FROM who
  UNION ALL SELECT doc_id, 14, 0, 0, 'Gestão de equipe e planejamento', 'competencias' FROM who
  UNION ALL SELECT doc_id, 15, 0, 0, '{REPEATED}', 'competencias' FROM who WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 16, 0, 0, '', 'competencias' FROM who
  UNION ALL SELECT doc_id, 17, 0, 0, 'Idiomas', 'idiomas' FROM who
  UNION ALL SELECT doc_id, 18, 0, 0, 'Inglês', 'idiomas' FROM who),
lines AS (
  SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY a, b, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_off
  FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY a, b, c)),
blocks AS (
  SELECT doc_id, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS INTEGER) AS block_no, f AS from_line, t AS to_line, text
  FROM (SELECT doc_id, kind, min(line_no) AS f, max(line_no) AS t, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, kind))
"""

_RAW_LINE = """CASE o_orderkey % 8 WHEN 0 THEN '  Página ' || o_orderkey || ' de 9' WHEN 1 THEN {loc} WHEN 2 THEN {glue}
  WHEN 3 THEN 'Com J.Silva em ' || o_orderkey WHEN 4 THEN 'Campinas, SP' WHEN 5 THEN '2/5' WHEN 6 THEN 'Item ' || o_orderkey ELSE 'Campinas, sp, 3' END"""
_LOC, _LOC_CUT = "'Curitiba, Parana, Brasil Responsavel pela operacao completa da unidade ' || o_orderkey", "'Curitiba, Parana, Brasil' || chr(10) || 'Responsavel pela operacao completa da unidade ' || o_orderkey"
_GLUE, _GLUE_CUT = "'Fechei ' || o_orderkey || ' contas.Depois revi;Por fim'", "'Fechei ' || o_orderkey || ' contas. Depois revi; Por fim'"

#: Lines of the texts with personal data, what is left of each, and what stands at which place of it.
_PERSONAL = """
WITH c AS (SELECT c_custkey AS doc_id, c_custkey AS n, lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') AS two, lpad(CAST(c_custkey % 9000 + 1000 AS VARCHAR), 4, '0') AS four, 'c' || c_custkey || '@example.com' AS mail FROM customer),
parts AS (
  SELECT doc_id, 1 AS k, 'Fale com ' || mail || ' ou (' || two || ') 9' || four || '-' || four || '.' AS raw, 'Fale com [E-MAIL] ou [TELEFONE].' AS line,
    [{'kind': 'email', 'at': 9, 'len': length(mail)}, {'kind': 'telefone', 'at': 13 + length(mail), 'len': 15}] AS found FROM c
  UNION ALL SELECT doc_id, 2, CASE WHEN n % 2 = 0 THEN 'CPF: 1' || two || '.456.789-' || two ELSE 'Nascida em 01/02/1990' END, CASE WHEN n % 2 = 0 THEN '[CPF]' ELSE '[DATA DE NASCIMENTO]' END,
    [CASE WHEN n % 2 = 0 THEN {'kind': 'cpf', 'at': 0, 'len': 19} ELSE {'kind': 'nascimento', 'at': 0, 'len': 21} END] FROM c
  UNION ALL SELECT doc_id, 3, CASE WHEN n % 3 = 0 THEN 'CEP 3' || four || '-123' ELSE 'Mora na Rua das Flores, ' || two END, CASE WHEN n % 3 = 0 THEN '[CEP]' ELSE 'Mora na [ENDEREÇO]' END,
    [CASE WHEN n % 3 = 0 THEN {'kind': 'cep', 'at': 0, 'len': 13} ELSE {'kind': 'endereco', 'at': 8, 'len': 18} END] FROM c
  UNION ALL SELECT doc_id, 4, CASE WHEN n % 5 = 0 THEN 'Sou casada e tenho 34 anos' ELSE 'Tenho 12 anos de casa e 34 anos de estudo' END, CASE WHEN n % 5 = 0 THEN 'Sou [ESTADO CIVIL] e tenho [IDADE]' ELSE 'Tenho 12 anos de casa e 34 anos de estudo' END,
    CASE WHEN n % 5 = 0 THEN [{'kind': 'estado-civil', 'at': 4, 'len': 6}, {'kind': 'idade', 'at': 19, 'len': 7}] ELSE [] END FROM c
  UNION ALL SELECT doc_id, 5, CASE WHEN n % 7 = 0 THEN 'Sexo: feminino' ELSE 'RG: 12.345.678-9' END, CASE WHEN n % 7 = 0 THEN '[SEXO]' ELSE '[RG]' END,
    [CASE WHEN n % 7 = 0 THEN {'kind': 'sexo', 'at': 0, 'len': 14} ELSE {'kind': 'rg', 'at': 0, 'len': 16} END] FROM c
  UNION ALL SELECT doc_id, 6, CASE WHEN n % 2 = 0 THEN 'Ramal (31) 9' || four || chr(8201) || four ELSE 'Ramal 31 9' || four || chr(8239) || four END, 'Ramal [TELEFONE]',
    [{'kind': 'telefone', 'at': 6, 'len': CASE WHEN n % 2 = 0 THEN 15 ELSE 13 END}] FROM c),
placed AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts),
spans AS (SELECT doc_id, s.kind AS kind, CAST(start + s.at AS INTEGER) AS idx, CAST(s.len AS INTEGER) AS len FROM (SELECT doc_id, start, unnest(found) AS s FROM placed))
"""

_LAYOUT = """
WITH pg AS (SELECT o_orderkey, o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page_no FROM orders),
li AS (SELECT doc_id, page_no, o_orderkey, l_linenumber AS no FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN pg ON l_orderkey = o_orderkey),
cols AS (SELECT doc_id, page_no, o_orderkey, count(*) AS n, string_agg('linha ' || no, chr(10) ORDER BY no) AS l,
    string_agg('coluna ' || no || CASE WHEN no % 2 = 0 THEN '.' ELSE '' END, chr(10) ORDER BY no) AS r, bool_or(no = 1) AS has_first FROM li GROUP BY ALL),
texts AS (SELECT *, concat(CASE WHEN o_orderkey % 5 = 0 AND has_first THEN 'Titulo ' || o_orderkey || chr(10) ELSE '' END, l, CASE WHEN o_orderkey % 3 <> 0 THEN chr(10) || r ELSE '' END) AS text FROM cols)
"""

_SENTENCES = """string_split_regex(regexp_replace(text, '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')"""

ORACLE_SQL = {
    "source_size_guard": "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) * 5000 AS length, CAST(octet_length(encode(html)) AS BIGINT) * 5000 <= 26214400 AS accepted FROM pages",
    "items_normalize": _LAYOUT + """
SELECT doc_id, page_no, CAST(no * 4 AS INTEGER) AS item_no, 'linha ' || no AS str, 50.0::DOUBLE AS x, (700 - 20 * no)::DOUBLE AS y, 200.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM li
UNION ALL SELECT doc_id, page_no, CAST(no * 4 + 1 AS INTEGER), 'coluna ' || no || CASE WHEN no % 2 = 0 THEN '.' ELSE '' END, 350.0, (700 - 20 * no)::DOUBLE, 200.0, 10.0 FROM li WHERE o_orderkey % 3 <> 0
UNION ALL SELECT doc_id, page_no, CAST(no * 4 + 2 AS INTEGER), 'Titulo ' || o_orderkey, 50.0, 720.0, 500.0, 10.0 FROM li WHERE o_orderkey % 5 = 0 AND no = 1""",
    "load_text": "SELECT c_custkey AS doc_id, c_name AS text FROM customer WHERE c_custkey % 4 <> 0",
    "reject_no_text": """
WITH planted AS (SELECT -1 - doc_id AS doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(9) || ' ' END AS text FROM documents)
SELECT doc_id, 'sem-texto' AS reason FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM planted) WHERE text IS NULL OR NOT regexp_matches(text, '\\S')""",
    "extract_fenced": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'corpo ' || o_orderkey WHEN 1 THEN 'sem cerca ' || o_orderkey WHEN 2 THEN 'aberta ' || o_orderkey || chr(10) || 'ate o fim' ELSE 'sim ' || o_orderkey END AS body FROM orders""",
    "page_gutter": _LAYOUT + "SELECT doc_id, page_no, CASE WHEN o_orderkey % 3 <> 0 THEN 300.5::DOUBLE END AS gutter FROM cols",
    "page_lines": _LAYOUT + """
SELECT doc_id, page_no, CAST(n + CASE WHEN o_orderkey % 5 = 0 AND has_first THEN 1 ELSE 0 END AS BIGINT) AS n_lines, first_line FROM cols JOIN (
  SELECT doc_id, page_no, least(min('linha ' || no || CASE WHEN o_orderkey % 3 <> 0 THEN ' coluna ' || no || CASE WHEN no % 2 = 0 THEN '.' ELSE '' END ELSE '' END), min(CASE WHEN o_orderkey % 5 = 0 AND no = 1 THEN 'Titulo ' || o_orderkey END)) AS first_line FROM li GROUP BY ALL) USING (doc_id, page_no)""",
    "page_text": _LAYOUT + "SELECT doc_id, page_no, text FROM texts",
    "document_text": _LAYOUT + """
SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN NOT regexp_matches(before, '[.;:!?]$') AND regexp_matches(text, '^[a-z]') THEN chr(10) ELSE chr(10) || chr(10) END || text, '' ORDER BY page_no) AS text
FROM (SELECT doc_id, page_no, text, right(lag(text) OVER (PARTITION BY doc_id ORDER BY page_no), 1) AS before FROM texts) GROUP BY doc_id""",
    "page_furniture": "SELECT o_orderkey, o_orderkey % 8 = 0 AS furniture FROM orders",
    "glued_sentence": f"SELECT o_orderkey, {_RAW_LINE.format(loc=_LOC, glue=_GLUE_CUT)} AS line FROM orders",
    "location_split": f"SELECT o_orderkey, {_RAW_LINE.format(loc=_LOC_CUT, glue=_GLUE)} AS line FROM orders",
    "is_location": "SELECT o_orderkey, o_orderkey % 8 = 4 AS place FROM orders",
    "clean_text": f"""
SELECT o_custkey AS doc_id, coalesce(string_agg({_RAW_LINE.format(loc=_LOC_CUT, glue=_GLUE_CUT)}, chr(10) ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 8 <> 0), '') AS text FROM orders GROUP BY o_custkey""",
    "span_scan": """
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m, string_split_regex(text, '[0-9]+') AS g FROM documents),
e AS (SELECT doc_id, m, g, unnest(range(len(m))) AS k FROM d)
SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(coalesce(list_sum(list_transform(g[1:k + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0) AS INTEGER) AS idx, m[k + 1] AS quote FROM e""",
    "pii_spans": _PERSONAL + "SELECT doc_id, kind, idx, len FROM spans",
    "pii_redact": _PERSONAL + "SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM parts GROUP BY doc_id",
    "pii_summary": _PERSONAL + "SELECT doc_id, kind, count(*) AS n FROM spans GROUP BY doc_id, kind",
    "detect_heading": LINES + "SELECT doc_id, line_no, kind FROM lines WHERE a IN (2, 4, 8, 10, 13, 17)",
    "line_offsets": LINES + "SELECT doc_id, line_no, start_off FROM lines",
    "identity_block": LINES + "SELECT doc_id, line_no FROM lines WHERE a < 2",
    "assign_lines": LINES + "SELECT doc_id, line_no, line, kind FROM lines",
    "assign_override": LINES + "SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN 'outros' WHEN line_no IN (0, 2) THEN 'header' ELSE kind END AS kind FROM lines",
    "section_blocks": LINES + "SELECT doc_id, block_no, kind, from_line, to_line, text FROM blocks",
    "experience_text": LINES + "SELECT doc_id, text FROM blocks WHERE kind = 'experiencia'",
    "split_sections": LINES + """
, marks AS (SELECT *, sum(CASE WHEN a IN (2, 4, 8, 10, 13, 17) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no, max(line_no) OVER (PARTITION BY doc_id) AS last_no FROM lines)
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, min(kind) AS kind, min(CASE WHEN a IN (2, 4, 8, 10, 13, 17) THEN line END) AS heading,
  CAST(length(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE a NOT IN (2, 4, 8, 10, 13, 17)), ''), '^\\s+|\\s+$', '', 'g')) AS INTEGER) AS n_chars,
  min(start_off) AS start, CAST(max(start_off + length(line) + CASE WHEN line_no = last_no THEN 0 ELSE 1 END) AS INTEGER) AS stop
FROM marks WHERE section_no > 0 GROUP BY doc_id, section_no""",
    "section_text": LINES + "SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines WHERE a IN (14, 15) GROUP BY doc_id",
    "is_label_line": LINES + """
SELECT doc_id, line_no, line FROM lines WHERE a IN (0, 1, 11, 14, 18) OR (a = 5 AND doc_id % 3 <> 1) OR (a = 9 AND (c IN (1, 2) OR line = 'Atendi clientes.'))""",
    "strip_accents": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "sentences": f"""
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS k, s AS sentence FROM (
  SELECT conv_id, turn, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT conv_id, turn, {_SENTENCES} AS l, unnest(range(1, len({_SENTENCES}) + 1)) AS i FROM conversations)) WHERE s <> ''""",
    "paragraphs": LINES + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, h) AS INTEGER) AS para_no, text, h = 0 AS is_header FROM (
  SELECT doc_id, pos, 0 AS h, company || ' ' || role AS text FROM st
  UNION ALL SELECT doc_id, b, 1, line FROM lines WHERE a = 9 AND c = 4)""",
    "metric_answers": PERIODS + """
SELECT doc_id, CAST(n AS INTEGER) AS ord, CASE WHEN doc_id % 2 = 0 THEN 'cerca de ' || CAST(first_n * 10 AS VARCHAR) ELSE '' END AS answer FROM (
  SELECT doc_id, n, last_value(CAST(n AS VARCHAR)) OVER (PARTITION BY doc_id, company, role ORDER BY CAST(n * 10 AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)::INTEGER AS first_n
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ym DESC, pos) AS n FROM st WHERE o_orderkey % 4 = 1))""",
    "metric_questions": PERIODS + """
SELECT doc_id, CAST(n AS INTEGER) AS ord, CAST(k AS INTEGER) AS k, topic, question FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ym DESC, pos) AS n FROM st WHERE o_orderkey % 4 = 1),
  (VALUES (0, 'quantidade', 'Quantos itens, pessoas ou clientes isso envolveu?'), (1, 'resultado', 'Quanto mudou, comparado com antes?'), (2, 'prazo', 'Em quanto tempo, ou com que frequência?')) AS v(k, topic, question) WHERE n <= 7""",
    "scope_axes": LINES + f"""
SELECT doc_id, line_no, CASE WHEN line LIKE 'Implantei%' THEN 'decisao' WHEN line LIKE 'Coordenei%' OR line LIKE 'Liderei%' THEN 'lideranca' ELSE 'responsabilidade' END AS axes
FROM lines WHERE line LIKE 'Implantei%' OR line LIKE 'Coordenei%' OR line LIKE 'Liderei%' OR line = '{REPEATED}' OR line LIKE 'Gestão de equipe%'""",
    "scope_evidence": LINES + f"""
SELECT doc_id, 'proven' AS status, CASE WHEN line LIKE 'Implantei%' THEN 'decisao' ELSE 'lideranca' END AS axis, line AS quote FROM lines WHERE a = 9 AND (line LIKE 'Implantei%' OR line LIKE 'Coordenei%')
UNION ALL SELECT doc_id, 'claimed', 'lideranca', line FROM lines WHERE line LIKE 'Liderei%'
UNION ALL SELECT doc_id, 'claimed', 'responsabilidade', line || CASE WHEN a = 14 AND doc_id % 5 = 0 THEN ' {REPEATED}' ELSE '' END FROM lines WHERE a IN (6, 14)""",
    "scope_empty_axes": LINES + """
SELECT w.doc_id, axis FROM who w, (VALUES ('decisao', 0), ('responsabilidade', 9), ('lideranca', 1)) AS v(axis, k)
WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = w.doc_id AND st.o_orderkey % 4 = k)""",
    "buzzwords": LINES + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS ord, term, term AS quote, CAST(idx AS INTEGER) AS idx FROM (
  SELECT doc_id, term, start_off + instr(line, term) - 1 AS idx FROM lines, (VALUES ('proativo'), ('foco em resultados'), ('melhoria contínua')) AS v(term) WHERE a = 5 AND instr(line, term) > 0)""",
    "buzzword_line_counts": "SELECT doc_id, CAST(CASE doc_id % 3 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS n_lines, CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n_terms FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders)",
    "shared_shingles": """
WITH t AS (SELECT row_number() OVER () AS n, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}][\\p{L}\\p{N}.,]*'), lambda x: lower(strip_accents(x))) AS w, doc_id AS sec FROM documents),
s AS (SELECT DISTINCT sec, array_to_string(w[i:i + 7], ' ') AS shingle FROM (SELECT sec, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8))
SELECT shingle, count(*) AS n_secs FROM s GROUP BY shingle HAVING count(*) > 1""",
    "repeated_lines": f"SELECT doc_id, CAST(1 AS INTEGER) AS ord, '{REPEATED}' AS quote, 'resumo,competencias' AS kinds, 'Resumo e Competências' AS names FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders) WHERE doc_id % 5 = 0",
    "char_count": """
SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS part, CAST(length(nfc_normalize(text)) AS BIGINT) AS n FROM documents
UNION ALL SELECT 'turn', conv_id, turn, CAST(length(nfc_normalize(text)) AS BIGINT) FROM conversations""",
    "length_check": """
SELECT conv_id, turn, CAST(n AS INTEGER) AS length, CAST(l AS INTEGER) AS "limit", CAST(l - n AS INTEGER) AS remaining, n <= l AS fits
FROM (SELECT conv_id, turn, length(nfc_normalize(text)) AS n, CASE WHEN turn % 2 = 0 THEN 220 ELSE 2600 END AS l FROM conversations)""",
    "level_field_violations": """
WITH c AS (SELECT c_custkey AS doc_id FROM customer)
SELECT doc_id, 'D7 enum de nível' AS rule, 'Nível comprovado' AS field, CASE WHEN doc_id % 5 = 3 THEN 'Especialista | Gestor' WHEN doc_id % 2 = 0 THEN 'porque sim' ELSE '' END AS quote,
  CASE WHEN doc_id % 5 = 3 OR doc_id % 2 = 0 THEN 'valor fora do enum: Júnior | Pleno | Sênior | Especialista | Gestor | Diretor' ELSE 'campo ausente na saída' END AS detail FROM c WHERE doc_id % 5 >= 3
UNION ALL SELECT doc_id, 'D7 enum de nível', 'Distância', CASE WHEN doc_id % 3 = 1 THEN 'enorme' ELSE '' END,
  CASE WHEN doc_id % 3 = 1 THEN 'valor fora do enum: nenhuma | meio degrau | um degrau | dois ou mais' ELSE 'campo ausente na saída' END FROM c WHERE doc_id % 3 > 0""",
}
