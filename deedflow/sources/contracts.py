"""Contract pages composed from the order tables: two versions of a supply agreement per order, three pages each, with variants by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, user_id, pair_id, version, page_number, text)."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    line = t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"), F.min("l_partkey").alias("p_partkey"))
    joined = (
        t("orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .join(line, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_name"), "s_suppkey")
        .join(t("part").select("p_partkey", "p_name"), "p_partkey")
    )
    key, v = F.col("o_orderkey"), F.col("version")
    both = joined.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    days = 15 + key % 60 + F.when((v == 2) & (key % 3 == 0), 15).otherwise(0)
    buyer, seller = F.replace("c_name", F.lit("#"), F.lit(" ")), F.replace("s_name", F.lit("#"), F.lit(" "))
    seller_role = F.when((v == 2) & (key % 7 == 0), "Vendor").otherwise("Seller")
    one = F.concat(F.lit("SUPPLY AGREEMENT\nThis Agreement is entered into between "), buyer, F.lit(' ("Buyer") and '), seller, F.lit(' ("'), seller_role, F.lit('").\nEffective Date: '), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("."))
    two = F.concat(
        F.lit("1. Payment. Buyer shall pay "), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" dollars within "), days.cast("string"),
        F.lit(" days.\n2. Delivery. Seller must deliver "), F.col("p_name"), F.lit(" upon receipt of payment, at its sole discretion."),
    )
    dropped = (v == 2) & (key % 5 == 0)
    more = F.when(key % 6 == 1, "\nThe term is subject to automatic renewal.").when(key % 6 == 3, "\nSeller accepts a non-compete for one year.").otherwise("")
    three = F.concat(F.lit("3. Termination. Either party may terminate with 30 days written notice."), F.when(dropped, F.lit("")).otherwise(F.lit("\n4. Confidentiality. Seller shall keep all records confidential.")), more)
    pages = F.array(*[F.struct(F.lit(n).alias("page_number"), x.alias("text")) for n, x in ((1, one), (2, two), (3, three))])
    return both.select((key * 10 + v).cast("long").alias("document_id"), F.col("o_custkey").cast("long").alias("user_id"), key.cast("long").alias("pair_id"), "version", F.inline(pages))


#: The same pages for an engine that checks results.
CONTRACTS_SQL = """
li AS (SELECT l_orderkey, min(l_suppkey) AS sk, min(l_partkey) AS pk FROM lineitem GROUP BY 1),
agreement AS (
  SELECT o_orderkey AS k, o_orderkey * 10 + v AS document_id, o_custkey AS user_id, o_orderkey AS pair_id, v AS version,
         replace(c_name, '#', ' ') AS buyer, replace(s_name, '#', ' ') AS seller, p_name,
         strftime(o_orderdate, '%B %-d, %Y') AS d, CAST(floor(o_totalprice) AS BIGINT) AS amt,
         15 + o_orderkey % 60 + CASE WHEN v = 2 AND o_orderkey % 3 = 0 THEN 15 ELSE 0 END AS n_days
  FROM orders JOIN li ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON sk = s_suppkey JOIN part ON pk = p_partkey CROSS JOIN (VALUES (1), (2)) t(v)),
cpages AS (
  SELECT document_id, user_id, pair_id, version, 1 AS page_number,
         'SUPPLY AGREEMENT' || chr(10) || 'This Agreement is entered into between ' || buyer || ' ("Buyer") and ' || seller || ' ("' || CASE WHEN version = 2 AND k % 7 = 0 THEN 'Vendor' ELSE 'Seller' END || '").' || chr(10) || 'Effective Date: ' || d || '.' AS text FROM agreement
  UNION ALL
  SELECT document_id, user_id, pair_id, version, 2,
         '1. Payment. Buyer shall pay ' || amt || ' dollars within ' || n_days || ' days.' || chr(10) || '2. Delivery. Seller must deliver ' || p_name || ' upon receipt of payment, at its sole discretion.' FROM agreement
  UNION ALL
  SELECT document_id, user_id, pair_id, version, 3,
         '3. Termination. Either party may terminate with 30 days written notice.' || CASE WHEN version = 2 AND k % 5 = 0 THEN '' ELSE chr(10) || '4. Confidentiality. Seller shall keep all records confidential.' END
         || CASE k % 6 WHEN 1 THEN chr(10) || 'The term is subject to automatic renewal.' WHEN 3 THEN chr(10) || 'Seller accepts a non-compete for one year.' ELSE '' END FROM agreement)
"""
