"""Evidence of scope: decision, responsibility and leadership, quoted and never scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import flat, let, pattern
from spanlens.operators.metrics import LEAST_CHARS, sentences

#: Axes, their names, and what is said where an axis has no evidence.
AXES = ("decisao", "responsabilidade", "lideranca")
AXIS_LABEL = {"decisao": "Escopo de decisão", "responsabilidade": "Escopo de responsabilidade", "lideranca": "Liderança"}

PLAIN, NUMBER, PEOPLE = "plain", "number", "people"

#: Words for people, and stems with their axis, in lower case without accents.
#: NUMBER stems count only beside a digit, PEOPLE stems (in experience) only beside a word for people.
PEOPLE_WORDS = "equipes?|times?|pessoas|colaboradores|funcionarios|liderados|subordinados|analistas|estagiarios|profissionais|staff|teams?|direct reports?|headcount"
OF_TOOL = " ?(?:d[aeo]s?|[ao]s?) (chat|site|planilha|documento|arquivo|apresenta|relatorio|post|arte|conteudo|texto|formulario|dashboard|plataforma|material|banner|e-?mail)"
STEMS = (
    ("decisao", "defin", PLAIN),
    ("decisao", "decid", PLAIN),
    ("decisao", "estrutur", PLAIN),
    ("decisao", "implant", PLAIN),
    ("decisao", "redesenh", PLAIN),
    ("decisao", "reformul", PLAIN),
    ("decisao", "concebi", PLAIN),
    ("decisao", "estabelec", PLAIN),
    ("decisao", "prioriz", PLAIN),
    ("decisao", rf"cri(acao|ar|ei|ou)\b(?!{OF_TOOL})", PLAIN),
    ("decisao", "propus", PLAIN),
    ("decisao", "establish", PLAIN),
    ("decisao", "restructur", PLAIN),
    ("decisao", "overhaul", PLAIN),
    ("decisao", "prioriti", PLAIN),
    ("decisao", "creat", PLAIN),
    ("responsabilidade", "orcament", PLAIN),
    ("responsabilidade", "faturament", PLAIN),
    ("responsabilidade", "receita", PLAIN),
    ("responsabilidade", "responsavel por", PLAIN),
    ("responsabilidade", "sob minha", PLAIN),
    ("responsabilidade", "gest(ao|ionar|ionei) d[aeo]s? (caixa|fluxo de caixa|orcament|verba|custos|capital|divida|carteira|contas|equipe|time|pessoas|pessoal|area|areas|unidade|regia|filia|portfolio)", PLAIN),
    ("responsabilidade", "carteira d", PLAIN),
    ("responsabilidade", "ambito (nacional|regional|global)", PLAIN),
    ("responsabilidade", "clientes", NUMBER),
    ("responsabilidade", "usuarios", NUMBER),
    ("responsabilidade", "unidades", NUMBER),
    ("responsabilidade", "filiais", NUMBER),
    ("responsabilidade", "estados", NUMBER),
    ("responsabilidade", "paises", NUMBER),
    ("responsabilidade", "contratos", NUMBER),
    ("responsabilidade", "chamados", NUMBER),
    ("responsabilidade", "budget", PLAIN),
    ("responsabilidade", "revenue", PLAIN),
    ("responsabilidade", "responsible for", PLAIN),
    ("responsabilidade", "accountable for", PLAIN),
    ("responsabilidade", "owner(ship)? of", PLAIN),
    ("responsabilidade", "portfolio of", PLAIN),
    ("responsabilidade", "(customers|clients)", NUMBER),
    ("responsabilidade", "users", NUMBER),
    ("responsabilidade", "countries", NUMBER),
    ("lideranca", "lider", PEOPLE),
    ("lideranca", "gerenci", PEOPLE),
    ("lideranca", "coorden", PEOPLE),
    ("lideranca", "subordinad", PLAIN),
    ("lideranca", "reportavam", PLAIN),
    ("lideranca", "mentor", PEOPLE),
    ("lideranca", "chefi", PEOPLE),
    ("lideranca", "equipe (de|com) ", PLAIN),
    ("lideranca", "time (de|com) ", PLAIN),
    ("lideranca", r"led\b", PEOPLE),
    ("lideranca", "leader", PEOPLE),
    ("lideranca", "manag", PEOPLE),
    ("lideranca", "supervis", PEOPLE),
    ("lideranca", "coach", PEOPLE),
    ("lideranca", "team (of|with) ", PLAIN),
    ("lideranca", "direct report", PLAIN),
    ("lideranca", "headcount", PLAIN),
)

CLAIMING = ["resumo", "competencias"]


def scope_axes(text: Column, strict: bool) -> Column:
    """Axes that a text gives evidence of, in fixed order; one pattern for each axis and condition."""
    return let(flat(text), lambda bare: _axes(bare, strict))


def _axes(bare: Column, strict: bool) -> Column:
    digit, people = bare.rlike("[0-9]"), bare.rlike(pattern(rf"\b({PEOPLE_WORDS})\b", ignore_case=False))
    hits = {axis: F.lit(False) for axis in AXES}
    for axis, needs in dict.fromkeys((axis, needs) for axis, _, needs in STEMS):
        stems = [stem for of, stem, condition in STEMS if (of, condition) == (axis, needs)]
        hit = bare.rlike(pattern(rf"(?<![A-Za-z0-9_])(?:{'|'.join(stems)})", ignore_case=False))
        if needs == NUMBER:
            hit = hit & digit
        elif needs == PEOPLE and strict:
            hit = hit & people
        hits[axis] = hits[axis] | hit
    return F.array_compact(F.array(*[F.when(hits[axis], axis) for axis in AXES]))


def _evidence(paras: DataFrame, strict: bool) -> DataFrame:
    """``(doc_id, para_no, part, axis, quote, bare)``: by sentence, or by paragraph where no sentence hits.

    ``bare`` paragraphs have no axis at all.  For a plain explode the optimizer puts all that makes
    the array into a filter below it, several times over; for an outer one it does not.
    """
    cut = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("quote"), scope_axes(s, strict).alias("axes")))
    rows = paras.select("doc_id", "para_no", "text", cut.alias("cut"))
    some = F.exists("cut", lambda c: F.size(c["axes"]) > 0)
    alone = F.get("cut", F.lit(0))["quote"] == F.col("text")
    whole = F.array(F.struct(F.col("text").alias("quote"), scope_axes(F.col("text"), strict).alias("axes")))
    rows = rows.select("doc_id", "para_no", F.when(some | alone, F.col("cut")).otherwise(whole).alias("cut"))
    rows = rows.withColumn("bare", ~F.exists("cut", lambda c: F.size(c["axes"]) > 0))
    rows = rows.select("doc_id", "para_no", "bare", F.posexplode_outer("cut").alias("part", "c"))
    return rows.select("doc_id", "para_no", "part", "bare", F.col("c.quote").alias("quote"), F.explode_outer("c.axes").alias("axis"))


def scope_evidence(experience: DataFrame, claims: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``(doc_id, status, axis, quote, ord)`` of `paragraphs`: proven in experience, claimed elsewhere, or unclassified."""
    inside = _evidence(experience.where(~F.col("is_header")), strict=True)
    outside = _evidence(claims, strict=False)
    rank = F.array_position(F.array(*[F.lit(a) for a in AXES]), F.col("axis")).cast("int")
    order = (F.col("para_no") * 1_000_000 + F.col("part") * 10 + F.coalesce(rank, F.lit(0))).cast("long")
    status = F.when(F.col("axis").isNotNull(), "proven").when(F.col("bare") & (F.char_length("quote") >= least), "unclassified")
    found = inside.select("doc_id", status.alias("status"), "axis", "quote", order.alias("ord")).where("status IS NOT NULL")
    claimed = outside.where("axis IS NOT NULL").select("doc_id", F.lit("claimed").alias("status"), "axis", "quote", order.alias("ord"))
    return found.unionByName(claimed)


def scope_empty_axes(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(doc_id, axis)`` of axes without proven evidence: every document's axes, left anti."""
    wanted = docs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(a) for a in AXES])).alias("axis"))
    return wanted.join(evidence.where("status = 'proven'"), ["doc_id", "axis"], "left_anti")
