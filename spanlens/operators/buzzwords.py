"""Generic terms, quoted as they stand."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import WORD_EDGE, begins, let, lines_of, spans, strip_accents

#: The terms.
BUZZWORDS = (
    "orientado a resultados", "orientada a resultados", "proativo", "proativa", "proatividade", "espírito de dono", "dono do negócio", "alavancar",
    "dinâmico", "dinâmica", "hands-on", "hands on", "mão na massa", "fora da caixa", "pensar fora da caixa", "sinergia", "multitarefas", "polivalente",
    "excelente comunicação", "ótima comunicação", "boa comunicação interpessoal", "facilidade de comunicação", "visão estratégica", "visão sistêmica",
    "alta performance", "apaixonado por", "apaixonada por", "resiliente", "flexível e adaptável", "comprometido com resultados",
    "comprometida com resultados", "gerar valor", "entregar valor", "impactar positivamente", "protagonismo", "ninja", "fera em", "antenado",
    "antenada", "melhoria contínua", "foco no cliente", "foco em resultados", "alto desempenho", "alta complexidade", "trabalho em equipe",
    "relacionamento interpessoal", "liderança exemplar", "liderança inspiradora", "senso de dono", "senso de urgência", "agregar valor",
    "vasta experiência", "ampla experiência", "sólido conhecimento", "sólidos conhecimentos", "visão de negócio", "visão 360", "perfil analítico",
    "movido por desafios", "gosto por desafios", "excelência operacional", "busca pela excelência",
)


def _plain(term: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", term) if not 0x300 <= ord(c) <= 0x36F)


_BEGIN = begins([_plain(t)[:4] for t in BUZZWORDS])
RULE = f"(?iu)(?<![A-Za-z0-9_])(?={_BEGIN})(?:" + "|".join(re.escape(_plain(t)) for t in BUZZWORDS) + ")" + WORD_EDGE


def buzzword_spans(text: Column) -> Column:
    """``(idx, quote)`` of each term, found without accents and quoted with them.

    Text in decomposed form changes its length without accents; such text is
    searched as it is, so places stay right.
    """
    found = spans(let(strip_accents(text), lambda bare: F.when(F.char_length(bare) == F.char_length(text), bare).otherwise(text)), RULE)
    return F.transform(
        found, lambda s: F.struct(s["idx"].alias("idx"), F.call_function("substring", text, s["idx"] + 1, F.char_length(s["quote"])).alias("quote"))
    )


def buzzwords(docs: DataFrame) -> DataFrame:
    """``(doc_id, ord, term, quote, idx)`` in order of place."""
    rows = docs.select("doc_id", F.posexplode_outer(buzzword_spans(F.col("text"))).alias("ord", "s")).where("ord IS NOT NULL")
    return rows.select("doc_id", "ord", F.lower("s.quote").alias("term"), "s.quote", "s.idx")


def buzzword_line_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_terms)``: lines that hold terms, and terms over all lines."""
    counts = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.size(buzzword_spans(x))), lambda n: n > 0)
    rows = docs.select("doc_id", counts.alias("counts"))
    return rows.select("doc_id", F.size("counts").alias("n_lines"), F.aggregate("counts", F.lit(0), lambda a, n: a + n).alias("n_terms"))
