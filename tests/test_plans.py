"""Plans that hold each expensive expression once."""

from spanlens.operators import render, scope


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def paras(spark):
    rows = [(1, 1, "Defini a meta. Nada mais.", False), (1, 2, "Coisa sem nenhum termo que conte para algum dos eixos.", False), (1, 3, "Curta.", False), (1, 4, "Defini a sede", True)]
    return spark.createDataFrame(rows, "doc_id long, para_no int, text string, is_header boolean")


def test_scope_looks_for_each_stem_once(spark):
    found = scope.scope_evidence(paras(spark), paras(spark).drop("is_header").where("para_no = 1"))
    # sentences and whole paragraphs, of experience and of claims
    assert plan_of(found).count("reportavam") == 4


def test_scope_statuses(spark):
    found = scope.scope_evidence(paras(spark), paras(spark).drop("is_header").where("para_no = 1"))
    assert sorted((r.status, r.axis, r.quote, r.ord) for r in found.collect()) == [
        ("claimed", "decisao", "Defini a meta.", 1_000_001),
        ("proven", "decisao", "Defini a meta.", 1_000_001),
        ("unclassified", None, "Coisa sem nenhum termo que conte para algum dos eixos.", 2_000_000),
    ]


def test_bodies_are_redacted_once(spark):
    blocks = spark.createDataFrame([(1, 0, "resumo", "Resumo\nAna, 34 anos"), (1, 1, "outros", "\n \n")], "doc_id long, block_no int, kind string, text string")
    found = render.bodies(blocks)
    assert plan_of(found).count("[ESTADO CIVIL]") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 0, "resumo", "Ana, [IDADE]")]
