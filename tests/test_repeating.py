"""Documents that repeat nothing are told before their tokens become rows."""

from spanlens.operators import repetition

ONCE = "Responsavel por todo o processo de compras da empresa com foco em qualidade prazo e custo"


def held(spark):
    rows = [
        (1, 0, "resumo", f"Resumo\n{ONCE}"), (1, 1, "competencias", f"Competências\n{ONCE.upper()}"), (1, 2, "outros", "Outros"),
        (2, 0, "resumo", f"Resumo\n{ONCE}"), (2, 1, "outros", "um dois três quatro cinco seis sete oito nove"),
        (3, 0, "resumo", f"{ONCE} {ONCE}"), (4, 0, "resumo", ""), (4, 1, "outros", ""),
        (5, 0, "resumo", "Ação um, dois.três çã́o cinco 6 sete oito"), (5, 1, "outros", "x acao UM, dois.tres cáo cinco 6 sete oito y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, sec int, kind string, text string")


def test_only_documents_that_repeat_are_taken_apart(spark):
    rows = held(spark)
    kept = repetition.repeating(rows)
    shared = {r.doc_id for r in repetition.shared_shingles(repetition.shingles(repetition.tokens(rows))).collect()}
    assert {r.doc_id for r in kept.collect()} == shared == {1, 5}
    assert kept.count() == 5
    told = lambda s: sorted(map(tuple, repetition.section_names(repetition.repeated_lines(s), s).collect()))
    assert told(kept) == told(rows) and len(told(kept)) == 1
