"""Career documents made from the tables: text rendered for each customer from their orders.

The tables hold no career documents, so text is written from rows, and the text
operators read it back; what they must find is known from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.operators.periods import format_month

#: Months count from year 0; August 2026 is the present of all queries.
NOW_YM = 2026 * 12 + 7

COMPANIES = {"1": "Companhia Urgente", "2": "Companhia Alta", "3": "Companhia Media", "4": "Companhia Comum", "5": "Companhia Baixa"}
REPEATED = "Responsavel por todo o processo de compras da empresa com foco em qualidade prazo e custo nas regionais do pais inteiro"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_of(date: str) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def order_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, pos, o_orderkey, start_ym, end_ym)``: an order runs from its month to its last shipment's.

    Every 13th order states years only; every 17th still runs.
    """
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(month_of("l_shipdate")).alias("last_ym"))
    orders = table(spark, sf_dir, "orders").withColumn("s", month_of("o_orderdate"))
    rows = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey).withColumn("e", F.greatest("last_ym", "s"))
    years = F.col("o_orderkey") % 13 == 0
    start = F.when(years, F.floor(F.col("s") / 12) * 12).otherwise(F.col("s")).cast("int")
    end = F.when(years, F.floor(F.col("e") / 12) * 12 + 11).otherwise(F.col("e")).cast("int")
    pos = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    return rows.select(
        F.col("o_custkey").alias("doc_id"), pos.alias("pos"), "o_orderkey", start.alias("start_ym"), F.when(F.col("o_orderkey") % 17 != 0, end).alias("end_ym"),
        "o_orderstatus", "o_orderpriority", years.alias("years_only"),
    )


def _said(ym: Column, years: Column) -> Column:
    return F.when(years, F.floor(ym / 12).cast("string")).otherwise(format_month(ym))


def career_documents(spark: SparkSession, sf_dir: str, unshipped: bool = False) -> DataFrame:
    """``(doc_id, text)`` for each customer with shipped orders.

    With ``unshipped`` those whose orders never shipped have documents too, without periods.
    """
    rows = order_periods(spark, sf_dir)
    company = F.create_map(*[F.lit(x) for pair in COMPANIES.items() for x in pair])[F.substring("o_orderpriority", 1, 1)]
    dates = F.concat(
        _said(F.col("start_ym"), F.col("years_only")), F.when(F.col("years_only"), " a ").otherwise(" - "), F.coalesce(_said(F.col("end_ym"), F.col("years_only")), F.lit("atual"))
    )
    kind = F.col("o_orderkey") % 4
    told = (
        F.when(kind == 0, F.concat(F.lit("Implantei o novo fluxo de pedidos e reduzi o prazo em "), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit("%.\n")))
        .when(kind == 1, "Coordenei a equipe de atendimento da regional durante todo o projeto.\n")
        .when(kind == 3, "Atendi clientes.\n")
        .otherwise("")
    )
    stint = F.concat(company, F.lit("\nAnalista "), F.col("o_orderstatus"), F.lit("\n"), dates, F.lit("\n"), told)
    jobs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", stint.alias("t")))), lambda s: s["t"]), "\n").alias("jobs"))
    if unshipped:
        ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")).distinct()
        jobs = ordered.join(jobs, "doc_id", "left").select("doc_id", F.coalesce("jobs", F.lit("")).alias("jobs"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.initcap("c_mktsegment").alias("segment"), "c_nationkey")
    summary = (
        F.when(F.col("doc_id") % 3 == 0, "Profissional proativo com foco em resultados.")
        .when(F.col("doc_id") % 3 == 1, "Liderei projetos de melhoria contínua com equipe de dados.")
        .otherwise("Atuo com dados.")
    )
    again = F.when(F.col("doc_id") % 5 == 0, f"\n{REPEATED}").otherwise("")
    text = F.concat(
        F.col("segment"), F.lit(" Silva\nAnalista | "), F.col("segment"), F.lit(" | Nacao "), F.col("c_nationkey").cast("string"),
        F.lit("\nContato: c"), F.col("doc_id").cast("string"), F.lit("@example.com\n\nResumo\n"), summary, again,
        F.lit("\n\nExperiência\n"), F.col("jobs"), F.lit("\nFormação\nBacharel em Engenharia\n\nCompetências\nGestão de equipe e planejamento"), again, F.lit("\n\nIdiomas\nInglês"),
    )
    return who.join(jobs, "doc_id").select("doc_id", text.alias("text"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, job_no, text)``: three postings for each customer with orders, from their columns."""
    customers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")).distinct()
    n = F.col("doc_id")
    first = F.concat(F.lit("Analista de dados. Mínimo de "), (n % 9 + 2).cast("string"), F.lit(" anos de experiência em dados. Inglês desejável."))
    second = F.concat(
        F.lit("Companhia Alta contrata analista de planejamento; certificação PMP obrigatória"), F.when(n % 2 == 0, " ou CPA-20").otherwise(""), F.lit(". Graduação completa é diferencial.")
    )
    third = F.when(n % 4 == 0, "  ").otherwise(F.concat(F.lit("Coordenador de vendas, dados de mercado. "), F.when(n % 3 == 0, "Espanhol.").otherwise("Perfil flexível.")))
    listed = F.posexplode(F.array(first, second, third))
    return customers.select("doc_id", listed.alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("job_no"), "text")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, artifact, target_role, target_level, industry, country, disclosure)``."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment", "c_nationkey")
    n = F.col("doc_id")
    return who.select(
        "doc_id",
        F.when(n % 3 == 0, "linkedin").when(n % 3 == 1, "curriculo").otherwise("ambos").alias("artifact"),
        F.when(n % 6 == 0, "").when(n % 6 < 3, "Analista de planejamento").otherwise("Coordenador de vendas").alias("target_role"),
        F.when(n % 2 == 0, "Pleno").otherwise("").alias("target_level"),
        F.initcap("c_mktsegment").alias("industry"),
        F.concat(F.lit("Nacao "), F.col("c_nationkey").cast("string")).alias("country"),
        F.lit("").alias("disclosure"),
    )


def answers(metrics: DataFrame) -> DataFrame:
    """``(doc_id, metric_key, answer)``: every other document has answered what it was asked."""
    return metrics.where(F.col("doc_id") % 2 == 0).select("doc_id", "metric_key", F.concat(F.lit("cerca de "), (F.col("ord") * 10).cast("string")).alias("answer"))
