"""Scalar functions and the functions that extensions add."""

from pyspark.sql import functions as F

from ..functions import scalar
from .registry import Tables, query


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def date_extract(t: Tables):
    day = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.month(day).alias("month"), F.year(day).alias("year"), F.date_format(day, "yyyy-MM-dd").alias("day"), F.unix_timestamp(day.cast("timestamp")).alias("seconds"))


@query("SELECT event_id, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS later FROM events")
def date_arithmetic(t: Tables):
    return t.events.select("event_id", F.date_format(F.expr("ts + make_dt_interval(0, 0, 0, 90)"), "yyyy-MM-dd HH:mm:ss").alias("later"))


@query("SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, left(c_name, 8) AS head, c_name || '/' || c_mktsegment AS both FROM customer")
def string_funcs(t: Tables):
    return t.customer.select("c_custkey", F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"), F.left("c_name", F.lit(8)).alias("head"), F.concat_ws("/", "c_name", "c_mktsegment").alias("both"))


@query("SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), -1) AS region, nullif(n_regionkey, 2) AS bare FROM nation")
def null_funcs(t: Tables):
    bare = F.nullif(F.col("n_regionkey"), F.lit(2))
    return t.nation.select("n_nationkey", F.coalesce(bare, F.lit(-1)).alias("region"), bare.alias("bare"))


@query("SELECT p_partkey, round(p_retailprice * 1.1, 1) AS dearer, p_size % 7 AS rest, power(p_size, 2) AS square, CAST(p_size AS DOUBLE) / 4 AS quarter FROM part")
def math_funcs(t: Tables):
    size = F.col("p_size")
    return t.part.select("p_partkey", F.round(F.col("p_retailprice") * 1.1, 1).alias("dearer"), (size % 7).alias("rest"), F.pow(size, F.lit(2)).alias("square"), (size.cast("double") / 4).alias("quarter"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS word, CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS DOUBLE) AS tenth, CAST(o_custkey AS FLOAT) / 2 AS half FROM orders")
def casts(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("word"), F.col("o_totalprice").cast("decimal(12,1)").cast("double").alias("tenth"), (F.col("o_custkey").cast("float") / F.lit(2).cast("float")).cast("float").alias("half"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_extract(t: Tables):
    k = F.get_json_object("props", "$.k")
    return t.events.filter(k == "42").select("event_id", k.cast("long").alias("k"))


@query("""SELECT event_id FROM events WHERE json_contains(CAST(props AS JSON), '{"k": 42}')""")
def json_containment(t: Tables):
    return t.events.filter(scalar.json_contains(F.col("props"), {"k": 42})).select("event_id")


@query("SELECT doc_id FROM documents WHERE list_has_all(string_split(lower(text), ' '), ['the', 'and'])")
def array_contains_all(t: Tables):
    return t.documents.filter(scalar.contains_all(F.split(F.lower("text"), " "), F.array(F.lit("the"), F.lit("and")))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])stupid([^a-z]|$)')")
def text_search(t: Tables):
    return t.documents.filter(F.lower("text").rlike("(^|[^a-z])stupid([^a-z]|$)")).select("doc_id")


@query("SELECT c_custkey, sha256(c_name) AS digest, md5(c_name) AS short FROM customer")
def digests(t: Tables):
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("digest"), F.md5("c_name").alias("short"))


@query("SELECT c_custkey, c_name AS back, true AS hidden, 28 + length(c_name) AS bytes FROM customer")
def encrypt_decrypt(t: Tables):
    # a nonce of 12 bytes goes before the text and a tag of 16 after it
    key, mode = F.lit("0123456789abcdef"), F.lit("GCM")
    held = t.customer.select("c_custkey", "c_name", F.aes_encrypt("c_name", key, mode).alias("cipher"))
    hidden = F.instr(F.hex("cipher"), F.hex("c_name")) == 0
    return held.select("c_custkey", F.aes_decrypt("cipher", key, mode).cast("string").alias("back"), hidden.alias("hidden"), F.octet_length("cipher").cast("long").alias("bytes"))


@query("""SELECT c_custkey, lower(lpad(printf('%x', list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(c_name, '')]), lambda a, b: (a * 33 + b) % 4294967296)), 8, '0')) AS h FROM customer""")
def simple_hash(t: Tables):
    return t.customer.select("c_custkey", scalar.simple_hash(F.col("c_name")).alias("h"))


@query("SELECT n_name, reverse(n_name) AS back FROM nation")
def reverse_text(t: Tables):
    return t.nation.select("n_name", scalar.reverse_text(F.col("n_name")).alias("back"))


@query("SELECT i, CAST(i AS VARCHAR) = reverse(CAST(i AS VARCHAR)) AS palindrome FROM generate_series(0, 2000) s(i)")
def palindrome(t: Tables):
    return t.spark.range(0, 2001).select(F.col("id").alias("i"), scalar.is_palindrome(F.col("id").cast("string")).alias("palindrome"))


@query("SELECT p_partkey, CAST(starts_with(p_type, 'S') AS INTEGER) AS hit FROM part")
def prefix_match(t: Tables):
    return t.part.select("p_partkey", scalar.prefix_match(F.lit("S"), F.col("p_type")).alias("hit"))


@query("SELECT p_partkey, CAST(list_sum(range(1, p_size + 1)) AS BIGINT) AS total FROM part WHERE p_size > 0")
def array_sum(t: Tables):
    return t.part.filter("p_size > 0").select("p_partkey", scalar.int_array_sum(F.sequence(F.lit(1), F.col("p_size"))).alias("total"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END AS words FROM documents")
def word_count(t: Tables):
    return t.documents.select("doc_id", scalar.word_count(F.col("text")).cast("long").alias("words"))


@query("SELECT p_partkey, p_retailprice >= 950 AS cut FROM part")
def truncated_literal(t: Tables):
    return t.part.select("p_partkey", scalar.truncated_ge(F.col("p_retailprice"), 950.7).alias("cut"))


@query(None)
def random_order(t: Tables):
    return t.nation.orderBy(F.rand(7)).limit(5)


@query(None)
def table_sample(t: Tables):
    return t.orders.sample(0.1, seed=11).select("o_orderkey")
