import re
from collections import Counter

from pyspark.sql import functions as F

from spanlens.operators.pii import PATTERNS, TITLES
from spanlens.plans.registry import QUERIES
from tests.helpers import SF

PERSONAL = [
    "Ana Souza, ana@example.com\nTelefone (11) 98765-4321\nRG: 12.345.678-9",
    "Rua das Flores, nº 12, apto 3\nCEP 01234-567\nCPF: 123.456.789-00\nsolteira, 30 anos",
    "Nascida em 01/02/1990. Sexo: feminino\nb@c.org e d@e.org",
    "Nada pessoal aqui, só ação.",
    "",
    None,
]


W = "[A-Za-z0-9_]"
EDGE = f"(?:(?<!{W})(?={W})|(?<={W})(?!{W}))"


def slow_panel(docs):
    """Counts by title with Python's own expressions; a span that touches an earlier kind's is left out.

    As in the reference, an edge of a word, a digit and a letter are those of ASCII.
    """
    counts = Counter()
    for doc_id, text in docs:
        taken = []
        for kind, rule, ignore in PATTERNS:
            rule = rule.replace(r"\b", EDGE).replace(r"\w", W).replace(r"[\d.]", "[0-9.]").replace(r"\d", "[0-9]")
            for m in re.finditer(rule, text or "", re.IGNORECASE if ignore else 0):
                if not any(m.start() < b and a < m.end() for a, b in taken):
                    taken.append(m.span())
                    counts[doc_id, TITLES[kind]] += 1
    return sorted((d, t, n) for (d, t), n in counts.items())


def test_pii_panel_counts_all_kinds(spark, tmp_path):
    docs = list(enumerate(PERSONAL))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = slow_panel(docs)
    assert len({t for _, t, _ in want}) == len(TITLES)
    assert sorted(map(tuple, QUERIES["pii_panel"](spark, str(tmp_path)).collect())) == want


def test_pii_panel_reads_unaltered_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["pii_panel"](spark, SF).collect())) == slow_panel(docs)


def test_override_returns_every_line(spark):
    lines = QUERIES["assign_lines"](spark, SF).select("doc_id", "line_no", "kind").collect()
    want = sorted((d, n, {0: "header", 1: "outros", 2: "header"}.get(n, kind)) for d, n, kind in lines)
    assert max(n for _, n, _ in want) > 3
    assert sorted(map(tuple, QUERIES["assign_override"](spark, SF).collect())) == want


def test_documents_are_judged_on_their_own_text(spark, tmp_path):
    docs = [(d, " " if d in (3, 8) else "x" * 7) for d in range(15)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.doc_id for r in QUERIES["reject_no_text"](spark, str(tmp_path)).collect())
    assert got == sorted([*range(-15, 0), 3, 8])
