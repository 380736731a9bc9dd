from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlens.functions.text import WORD_EDGE, collapse, first_replaced, spans, strip_accents, trim
from spanlens.operators import clean
from tests.helpers import docs, one


def test_white_space_and_accents(spark):
    assert one(spark, trim, "  a b　", "", None) == ["a b", "", None]
    assert one(spark, collapse, " a \n\t b ") == ["a b"]
    assert one(spark, strip_accents, "ÁÉção ñ ü", "áb", "ß") == ["AEcao n u", "ab", "ß"]


def test_boundary_is_ascii(spark):
    assert one(spark, lambda c: c.rlike(WORD_EDGE + "gil"), "ágil", "agil") == [True, False]


def test_first_occurrence_only(spark):
    assert one(spark, lambda c: first_replaced(c, F.lit("a.")), "a.a.b", "b") == ["a.b", "b"]


def test_spans_quote_their_source(spark):
    rows = docs(spark, "x12y3", "", "no", "é1ç22", "\x01 9").select("text", F.explode(spans(F.col("text"), "[0-9]+")).alias("s")).collect()
    assert [(r.s.idx, r.s.quote) for r in rows] == [(1, "12"), (4, "3"), (1, "1"), (3, "22"), (2, "9")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \né2", max_size=30), min_size=1, max_size=20))
def test_spans_equal_a_scan(spark, texts):
    import re

    rows = docs(spark, *texts).select("doc_id", spans(F.col("text"), "[0-9]+").alias("s")).collect()
    for r in rows:
        assert [(s.idx, s.quote) for s in r.s] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", texts[r.doc_id])]


def test_spans_in_parts_and_groups(spark):
    import re

    texts = [" ".join(f"k{i}=é{i % 7}" for i in range(n)) for n in (31, 32, 33, 64, 65, 200, 1000)]
    rows = docs(spark, *texts).select("doc_id", spans(F.col("text"), "k([0-9]+)=(.)", 2).alias("s")).collect()
    for r in rows:
        assert [(s.idx, s.quote, s.g1, s.g2) for s in r.s] == [(m.start(), m[0], m[1], m[2]) for m in re.finditer("k([0-9]+)=(.)", texts[r.doc_id])]


def test_time_of_spans_and_redaction_grows_with_the_matches(spark):
    import time

    from spanlens.operators import pii

    took = {}
    for n in (16_000, 16_000, 64_000):
        numbers = docs(spark, " ".join(f"x{i}" for i in range(n)))
        mails = docs(spark, " ".join(f"a{i}@example.com, CEP 30123-456" for i in range(n // 2)))
        start = time.time()
        assert numbers.select(F.size(spans(F.col("text"), "[0-9]+")).alias("n")).first().n == n
        middle = time.time()
        assert pii.redact_documents(mails).select(F.size("pii").alias("n"), F.char_length("text").alias("c")).first().n == n
        took[n] = (middle - start, time.time() - middle)
    assert took[64_000][0] < 8 * took[16_000][0] + 2 and took[64_000][1] < 8 * took[16_000][1] + 2


def test_page_footers(spark):
    lines = ["Page 1 of 2", "  Página 3 de 10 ", "pág 1 de 2", "pag 1 de 2", "2/5", "Page one of two", "see Page 1 of 2"]
    assert one(spark, clean.is_page_furniture, *lines) == [True, True, True, True, False, False, False]


def test_glued_sentences(spark):
    lines = ["um.Dois;Três", "J.Silva", "versão 2.0", "fim.", "a.b"]
    assert one(spark, clean.unglue_sentence, *lines) == ["um. Dois; Três", "J.Silva", "versão 2.0", "fim.", "a.b"]


def test_locations(spark):
    lines = ["Belo Horizonte, Minas Gerais, Brasil", "São Paulo, SP", "Curitiba", "a, b", "Rio, 3", "Um, Dois, Tres, Quatro", "Fim: A, B"]
    assert one(spark, clean.is_location, *lines) == [True, True, False, False, False, False, False]


def test_clean_text_is_idempotent(spark):
    text = "Page 1 of 2\nUm.Dois\nCuritiba, Parana, Brasil Responsavel pela operacao completa da unidade\nx\n2/5"
    (once,) = one(spark, clean.clean_text, text)
    assert once == "Um. Dois\nCuritiba, Parana, Brasil\nResponsavel pela operacao completa da unidade\n x\n2/5"
    assert one(spark, clean.clean_text, once) == [once]
    assert one(spark, clean.clean_text, "", "a\n\n", None) == ["", "a\n\n", None]
