import pytest
from pyspark.sql import functions as F

from spanlens.functions.text import pattern
from spanlens.operators import jobs, layout, metrics, pii, scope, sections, stints, validate
from spanlens.operators.limits import char_count, length_check
from spanlens.operators.repetition import repeated_lines
from spanlens.plans.engine import Analysis, analyze
from spanlens.sources.documents import extract_fenced, read_text_files, strict_size, write_markdown
from spanlens.streaming.documents import analyze_stream, stream_buzzwords
from tests.helpers import docs, one

NOW = 2026 * 12 + 7

PERSONAL = {
    "email": "fale com ana@example.com hoje",
    "cpf": "CPF: 123.456.789-09",
    "rg": "RG: 12.345.678-9",
    "nascimento": "nascida em 01/02/1990",
    "cep": "CEP 30123-456",
    "telefone": "ligue (31) 99999-1234",
    "endereco": "Av. Central, 100, apto 12",
    "sexo": "Sexo: feminino",
    "estado-civil": "Estado civil: casada",
    "idade": "24 ANOS",
}


def kinds(spark, *texts):
    rows = docs(spark, *texts).select("doc_id", pii.pii_spans(F.col("text")).alias("s")).orderBy("doc_id").collect()
    return [[s.kind for s in r.s] for r in rows]


def test_personal_data_of_each_kind(spark):
    assert kinds(spark, *PERSONAL.values()) == [[k] for k in PERSONAL]
    clean = ["2 anos 8 meses", "5 anos de experiência", "30 anos de casa", "08/2013 - 06/2017", "versão 1.2.3", "", None]
    assert kinds(spark, *clean) == [[] for _ in clean]


def test_hints_hold_wherever_a_pattern_matches(spark):
    """Every way to write each kind, with all spaces and cases that its pattern takes, passes the hint."""
    spaces = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    base = [
        "ana@example.com", "123.456.789-09", "RG: 12.345.678-9", "Carteira de Identidade 12345", "registro geral: MG-12.345", "data de nascimento: 1/2/90", "nascido em 01.02.1990", "CEP: 30123-456",
        "(31) 99876 5432", "31 9987 5432", "+55 31 9 9876 . 5432", "Rua das Flores, 10", "R. Um dois", "AV. Central", "Praça da Sé", "praca Onze", "gênero: Feminino", "SEXO M", "Viúva", "união estável", "UNIAO ESTAVEL", "Idade: 34 anos", "24 ANOS",
    ]
    texts = [t.replace(" ", sp) for t in base for sp in spaces] + [f(t) for t in base for f in (str.upper, str.lower, str.title, lambda t: t.replace("s", "\u017f").replace("i", "\u0131"), lambda t: t.replace("i", "\u0130"))]
    rows = docs(spark, *texts)
    for kind in pii.HINTS:
        rules = [F.col("text").rlike(pattern(rule, ignore)) for k, rule, ignore in pii.PATTERNS if k == kind]
        hit = rules[0] if len(rules) == 1 else rules[0] | rules[1]
        marked = rows.select("text", hit.alias("hit"), F.expr(pii.hinted_sql(kind, pii.lowered_sql("text"))).alias("hinted")).collect()
        assert [r.text for r in marked if r.hit and not r.hinted] == [], kind
        assert any(r.hit for r in marked), kind


def test_numbers_with_odd_spaces_are_taken_out(spark):
    assert one(spark, pii.redact, "(31) 99876\u20095432", "31 99876\u202f5432", "31\u30009987\u20285432") == ["[TELEFONE]"] * 3


def test_redaction(spark):
    texts = ["Contato: a@example.com e (31) 99999-1234.", "nada aqui", "quebrado ana@gmail.c\nom fim", "🚀 a@example.com"]
    assert one(spark, pii.redact, *texts) == ["Contato: [E-MAIL] e [TELEFONE].", "nada aqui", "quebrado [E-MAIL] fim", "🚀 [E-MAIL]"]
    assert one(spark, pii.redact, *one(spark, pii.redact, *texts)) == one(spark, pii.redact, *texts)


def test_headings(spark):
    good = {"EXPERIÊNCIA": "experiencia", "Formação Acadêmica:": "formacao", "Skills": "competencias", "• Idiomas": "idiomas", "Licenses & Certifications": "certificacoes", "About": "resumo", "Contato": "contato"}
    assert one(spark, sections.detect_heading, *good) == list(good.values())
    bad = ["Experiência em vendas e atendimento ao cliente final", "Resumo.", "", "Skills,", "x" * 61, "Joana", None]
    assert one(spark, sections.detect_heading, *bad) == [None] * len(bad)


def test_forward_fill_and_identity(spark):
    text = "Skills\nPython\nAna Souza\nDev | Dados | Nuvem\nSão Paulo, Brasil\nligar depois\nmais um\nExperiência\nAcme"
    rows = sections.assign_lines(sections.line_rows(docs(spark, text))).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["competencias"] * 2 + ["contato"] * 4 + ["competencias"] + ["experiencia"] * 2
    assert all(text[r.start_off : r.start_off + len(r.line)] == r.line for r in rows)
    blocks = sections.section_blocks(sections.assign_lines(sections.line_rows(docs(spark, text)))).orderBy("block_no").collect()
    assert [(b.kind, b.from_line, b.to_line) for b in blocks] == [("competencias", 0, 1), ("contato", 2, 5), ("competencias", 6, 6), ("experiencia", 7, 8)]


def labels(spark, text):
    lines = sections.line_rows(docs(spark, text))
    from spanlens.operators.periods import period_rows

    return [(r.label, r.company) for r in stints.job_stints(lines, period_rows(docs(spark, text))).orderBy("pos").collect()]


def test_stint_labels(spark):
    assert labels(spark, "Acme\nAnalista\n01/2015 - 01/2016") == [("Acme — Analista", "Acme")]
    assert labels(spark, "Acme\nAnalista\n01/2015 - 01/2016\nCoordenador\n02/2016 - 01/2017") == [("Acme — Analista", "Acme"), ("Acme — Coordenador", "Acme")]
    assert labels(spark, "Acme\nAnalista\n01/2015 - 01/2016\n\nGerente\n02/2016 - 01/2017") == [("Acme — Analista", "Acme"), ("Gerente", None)]
    assert labels(spark, "01/2015 - 01/2016\n02/2016 - 01/2017") == []
    assert labels(spark, "Acme\n2 anos 3 meses\nAnalista\n01/2015 - 01/2016") == [("Acme — Analista", "Acme")]
    assert labels(spark, "• Fiz a gestão completa de todas as contas do time;\n01/2015 - 01/2016\nAcme") == [("Acme", None)]


def test_metrics(spark):
    text = "Acme\nAnalista\n01/2015 - 01/2016\n- Reduzi o prazo de entrega em 30% no primeiro ano inteiro\n- Conduzi a implantação do novo sistema de vendas da\nempresa em todas as regionais. Vendas.\n\nBeta\nGerente\n02/2016 - 01/2018\nVendas."
    lines = sections.line_rows(docs(spark, text))
    from spanlens.operators.periods import period_rows

    found = stints.job_stints(lines, period_rows(docs(spark, text)))
    paras = metrics.paragraphs(lines)
    missing = metrics.missing_metrics(paras, found).collect()
    assert [(r.quote, r.label) for r in missing] == [("Conduzi a implantação do novo sistema de vendas da empresa em todas as regionais.", "Acme — Analista")]
    assert [r.label for r in metrics.silent_stints(paras, found).collect()] == ["Beta — Gerente"]


def test_scope_axes(spark):
    strict = lambda c: scope.scope_axes(c, True)
    lines = ["Implantei o processo", "Coordenei equipes", "Coordenei relatórios", "Atendi 300 clientes", "Atendi clientes", "Criação de planilha", "Gestão de orçamento", "ágil"]
    assert one(spark, strict, *lines) == [["decisao"], ["lideranca"], [], ["responsabilidade"], [], [], ["responsabilidade"], []]
    assert one(spark, lambda c: scope.scope_axes(c, False), "Coordenei relatórios") == [["lideranca"]]


def test_repetition(spark):
    passage = "um dois tres quatro cinco seis sete oito nove dez onze doze treze quatorze"
    rows = [(1, 0, "header", f"antes {passage} fim"), (1, 1, "resumo", f"Outro texto: {passage} e mais"), (1, 2, "outros", "um dois tres"), (2, 0, "header", f"{passage} {passage}")]
    found = repeated_lines(spark.createDataFrame(rows, "doc_id long, sec int, kind string, text string")).collect()
    assert [(r.doc_id, r.sec, r.quote, r.secs) for r in found] == [(1, 0, passage, [0, 1])]


def test_lengths(spark):
    assert one(spark, char_count, "🚀", "é", "é", "", None) == [1, 1, 1, 0, None]
    rows = length_check(docs(spark, "x" * 220, "x" * 221), "text", "headline").orderBy("doc_id").collect()
    assert [(r.remaining, r.fits) for r in rows] == [(0, True), (-1, False)]


def test_requirements(spark):
    posting = spark.createDataFrame([(1, 1, "Mínimo de 12 anos de experiência em vendas. Certificação PMP será um diferencial; MBA desejável\nInglês fluente")], "doc_id long, job_no int, text string")
    rows = jobs.job_requirements(posting).orderBy("ord").collect()
    assert [(r.kind, r.modality, r.years) for r in rows] == [("anos", "obrigatório", 12), ("certificacao", "diferencial", None), ("formacao", "desejável", None), ("idioma", "não declarada", None)]
    assert one(spark, jobs.acronyms, "PMP, CPA-20 ou PMP; abc A") == [["PMP", "CPA-20"]]
    assert one(spark, lambda c: jobs.in_document(c, F.lit("PMP")), "tenho pmp.", "tenho PMPs") == [True, False]


def test_vocabulary(spark):
    posting = spark.createDataFrame([(1, 1, "Gestão de Projetos, gestão ágil"), (1, 2, "gestao de projetos"), (1, 3, "  ")], "doc_id long, job_no int, text string")
    rows = jobs.job_vocabulary(posting, spark.createDataFrame([(1, "Fiz GESTÃO")], "doc_id long, text string")).orderBy("rank").collect()
    assert [(r.term, r["jobs"], r["count"], r.present) for r in rows] == [("Gestão", 2, 3, True), ("Projetos", 2, 2, False)]


def test_odd_jobs(spark):
    context = spark.createDataFrame([(1, "Analista de dados"), (2, "Piloto"), (3, "")], "doc_id long, target_role string")
    posting = spark.createDataFrame([(d, j, t) for d in (1, 2, 3) for j, t in ((1, "vaga de ANALISTA"), (2, "vaga de cozinha"))], "doc_id long, job_no int, text string")
    assert [(r.doc_id, r.job_no) for r in jobs.odd_jobs(posting, context).collect()] == [(1, 2)]


@pytest.mark.parametrize(
    "output, n",
    [
        ("NIVEL_COMPROVADO: Pleno\nNIVEL_PROMETIDO: **Sênior** sim\nDISTANCIA: um degrau.", 0),
        ("Nível comprovado (fase 1): pleno. Nível prometido: Gestor.\nDistância entre os dois: dois ou mais", 0),
        ("NIVEL_COMPROVADO: Pleno/Sênior\nNIVEL_PROMETIDO: Gestor\nDISTANCIA: nenhuma", 1),
        ("", 3),
    ],
)
def test_level_fields(spark, output, n):
    rows = validate.level_field_violations(spark.createDataFrame([(1, output)], "doc_id long, output string")).collect()
    assert len(rows) == n


def test_fenced(spark):
    texts = ["a\n```\nb\n```\nc\n```\nd\n```", " só ", "x\n```\ny\nz", "```js\nn\n```\ns\n```"]
    assert one(spark, extract_fenced, *texts) == ["b", "só", "y\nz", "s"]


def test_size(spark):
    rows = spark.createDataFrame([(26214400,), (26214401,)], "n long")
    assert rows.where("n = 26214400").select(strict_size(F.col("n"))).first()[0] == 26214400
    with pytest.raises(Exception, match="25 MiB"):
        rows.select(strict_size(F.col("n"))).collect()


def page(spark, items, width=600.0):
    rows = spark.createDataFrame([(1, 1, i, *it) for i, it in enumerate(items)], layout.ITEMS)
    pages = spark.createDataFrame([(1, 1, width, 800.0)], "doc_id long, page_no int, width double, height double")
    return layout.page_text(rows, pages).first().text


def test_layout(spark):
    assert page(spark, [("mundo", 60.0, 100.0, 30.0, 10.0), ("Olá", 20.0, 101.0, 30.0, 10.0), ("fim", 20.0, 80.0, 20.0, 10.0)]) == "Olá mundo\nfim"
    assert page(spark, [("pala", 20.0, 100.0, 20.0, 10.0), ("vra", 40.5, 100.0, 20.0, 10.0)]) == "palavra"
    columns = [(f"e{i}", 50.0, 700.0 - 20 * i, 200.0, 10.0) for i in range(4)] + [(f"d{i}", 350.0, 700.0 - 20 * i, 200.0, 10.0) for i in range(4)]
    assert page(spark, columns) == "e0\ne1\ne2\ne3\nd0\nd1\nd2\nd3"
    banner = [("TÍTULO", 50.0, 670.0, 500.0, 10.0)]
    assert page(spark, columns + banner) == "e0\ne1\nd0\nd1\nTÍTULO\ne2\ne3\nd2\nd3"


TEXT = """Ana Souza
Dev | Dados | Nuvem
ana@example.com

Resumo
Profissional proativa e hands-on.

Experiência
Acme
Analista
01/2015 - 06/2016
Implantei o novo processo de compras de toda a empresa sem ajuda.

Beta
Gerente
03/2018 - atual

Formação
Direito"""


def test_dossier(spark):
    a = Analysis(docs(spark, TEXT), NOW)
    context = spark.createDataFrame([(0, "ambos", "Gerente", "", "", "", "")], "doc_id long, artifact string, target_role string, target_level string, industry string, country string, disclosure string")
    posting = spark.createDataFrame([(0, 1, "Gerente na Beta. 5 anos de experiência.")], "doc_id long, job_no int, text string")
    answers = spark.createDataFrame([], "doc_id long, metric_key string, answer string")
    (row,) = a.dossiers(context, posting, answers, prompt="INSTRUÇÕES").collect()
    said = row.markdown
    for part in (
        "INSTRUÇÕES", "FASE INICIAL: 3", "- Os números de 1 trecho dos dois vínculos mais recentes.", "### Experiência", "### Trechos sem número (1)",
        "[FALTA NÚMERO: o que medir]", "  - 01/2015 – 06/2016 (1 ano e 6 meses)\n    ↳ 21 meses até o começo do próximo", "03/2018 – atual", "Beta — Gerente",
        '"proativa", "hands-on"', "e-mail", '- "Implantei o novo processo de compras de toda a empresa sem ajuda."', "> **Uma única vaga.**",
    ):
        assert part in said, part
    assert "ana@example.com" not in said and "Ana Souza" not in said
    order = [said.index(x) for x in ("FASE INICIAL", "## Documento", "## Respostas da pessoa", "## Achados", "## Evidência", "## Vagas-alvo")]
    assert order == sorted(order)


def test_empty_documents(spark):
    found = analyze(docs(spark, "", None, " \n"), NOW)
    assert all(found[n].collect() == [] for n in found)
    plain = analyze(docs(spark, "x"), NOW)
    assert sorted(r.axis for r in plain["empty_axes"].collect()) == sorted(scope.AXES)
    assert plain["periods"].collect() == [] and plain["stints"].collect() == []


def test_overrides(spark):
    overrides = spark.createDataFrame([(0, 1, 0, 0, "experiencia")], "doc_id long, seq int, from_line int, to_line int, kind string")
    a = Analysis(docs(spark, "Acme 01/2015 - 01/2016"), NOW, overrides)
    assert a.periods.count() == 1 and Analysis(docs(spark, "Acme 01/2015 - 01/2016"), NOW).periods.count() == 0


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", {}
    docs(spark, TEXT, "").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
    query = analyze_stream(stream, NOW, lambda n, df, b: out.update({n: df.count()}), str(tmp_path / "cp"), ["periods", "buzzwords", "gaps"])
    query.awaitTermination(120)
    assert query.exception() is None and out == {"periods": 2, "buzzwords": 2, "gaps": 1}
    flat = stream_buzzwords(stream).writeStream.format("memory").queryName("terms").trigger(availableNow=True).start()
    flat.awaitTermination(120)
    assert spark.sql("SELECT count(*) AS n FROM terms").first().n == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Olá\nmundo")
    assert read_text_files(spark, str(tmp_path / "a.txt")).first().text == "Olá\nmundo"
    write_markdown(spark.createDataFrame([(7, "# x\ny"), (5, "z")], "doc_id long, markdown string"), str(tmp_path / "md"), buckets=1)
    files = list((tmp_path / "md" / "bucket=0").glob("*.txt"))
    assert [f.read_text() for f in files] == ["<!-- document 5 -->\nz\n<!-- document 7 -->\n# x\ny\n"]


def test_pdf_pages_become_items(spark, tmp_path, monkeypatch):
    """With a stand-in for the library: its spans are items in the order and places that layout takes."""
    from spanlens.sources import pdf

    (tmp_path / "fitz.py").write_text(
        """
class Page:
    class rect:
        width, height = 600.0, 800.0
    def __init__(self, spans):
        self.spans = spans
    def get_text(self, kind):
        lines = [{"spans": [{"text": t, "bbox": (x, 0, x + w, 0), "size": 10, "origin": (x, y)} for t, x, y, w in self.spans]}]
        return {"blocks": [{"lines": lines}, {"image": b""}]}
class Document(list):
    def __enter__(self):
        return self
    def __exit__(self, *a):
        pass
def open(stream, filetype):
    assert filetype == "pdf"
    return Document(Page(eval(p)) for p in stream.decode().splitlines())
"""
    )
    spark.sparkContext.addPyFile(str(tmp_path / "fitz.py"))
    (tmp_path / "a.pdf").write_text("[('mundo', 60.0, 100.0, 30.0), ('Olá', 20.0, 100.0, 30.0)]\n[('fim', 20.0, 50.0, 9.0)]")
    monkeypatch.setattr(pdf, "available", lambda: True)
    raw = pdf.read_pdf_items(spark, str(tmp_path / "*.pdf"))
    pages = raw.select("doc_id", "page_no", F.col("page_width").alias("width"), F.col("page_height").alias("height")).distinct()
    found = layout.page_text(layout.normalize_items(raw), pages).orderBy("page_no").collect()
    assert [(r.page_no, r.text) for r in found] == [(1, "Olá mundo"), (2, "fim")]


def slow_page(items, width):
    """Text of a page from its definition, item by item."""
    blank = lambda t: not t.strip()

    def lines(some):
        left = sorted((i for i in some if i[0] != ""), key=lambda i: (-i[2], i[1]))
        tall = sorted(i[4] for i in left if i[4] > 0)
        reach = 0.5 * (tall[len(tall) // 2] if tall else 10.0)
        out = []
        while left:
            row = [i for i in left if left[0][2] - i[2] <= reach]
            left = left[len(row) :]
            said, edge = "", None
            for t, x, _, w, h in sorted(row, key=lambda i: i[1]):
                said += (" " if edge is not None and x - edge > 0.2 * h and not said[-1].isspace() else "") + t
                edge = x + w
            out.append(" ".join(said.split()))
        return [x for x in out if x]

    body = [i for i in items if not blank(i[0]) and i[3] < 0.6 * width]
    covered = {b for _, x, _, w, _ in body for b in range(max(0, int(x // 1)), min(int(width + 0.5) - 1, -int(-(x + w) // 1)) + 1)}
    best = None
    for a in range(int(width + 0.5)):
        for b in range(a + 1, int(width + 0.5) + 1):
            if any(k in covered for k in range(a, b)):
                break
            if (a == 0 or a - 1 in covered) and (b == int(width + 0.5) or b in covered) and b - a >= 0.03 * width and 0.2 * width <= (a + b) / 2 <= 0.8 * width:
                best = max(best or (0, 0.0), (b - a, (a + b) / 2), key=lambda r: r[0])
    g = best and best[1]
    if not g or min(sum(i[1] + i[3] <= g for i in body), sum(i[1] >= g for i in body)) < 0.15 * len(body):
        return "\n".join(lines(items))
    cross = [i for i in items if i[1] < g < i[1] + i[3]]
    tops = sorted({i[2] for i in cross if not blank(i[0])}, reverse=True)
    out = []
    for k in range(len(tops) + 1):
        own = [i for i in items if i not in cross and sum(t > i[2] + 1 for t in tops) == k]
        out += lines([i for i in own if i[1] + i[3] <= g]) + lines([i for i in own if i[1] > g])
        if k < len(tops):
            out += lines([i for i in cross if i[2] == tops[k] and not blank(i[0])])
    return "\n".join(out)


def test_layout_equals_its_definition():
    import random

    import numpy as np

    rng = random.Random(8)
    two = 0
    for _ in range(150):
        items = []
        for _ in range(rng.randint(0, 30)):
            x = rng.choice([rng.uniform(0, 20), rng.uniform(52, 60), rng.uniform(0, 90)])
            items.append((rng.choice(["a", "bc", " ", "", "d ", " e"]), x, rng.choice([10.0, 11.0, 14.0, 20.0, 23.0, 40.0]), rng.choice([5.0, 20.0, 30.0, 95.0]), rng.choice([0.0, 4.0, 10.0])))
        columns = [np.array([i[k] for i in items], object if k == 0 else float) for k in range(5)]
        page = layout.Page(*columns, 100.0)
        two += page.gutter() is not None
        assert page.reading() == slow_page(items, 100.0), items
    assert two > 20


def test_pdf_needs_a_library(spark, tmp_path):
    from spanlens.sources import pdf

    if not pdf.available():
        with pytest.raises(ImportError, match="PyMuPDF"):
            pdf.read_pdf_items(spark, str(tmp_path))
