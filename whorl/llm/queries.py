"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, html_text, jaccard, licenses, periodic, pii, quality, secrets, sharding, token_files, tokens, url_lists
from .common import Scratch, table
from .oracles import ORACLES  # noqa: F401


def ranks() -> dict:
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items in it."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes made by rule from the hosts of ``pages``.

    Each host is put on a list on a day given by its digest and taken off 90
    days later; each parent domain is allowed for 60 days; every host's
    ``/en`` prefix is blocked for good from a day on.
    """
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    day = lambda key, off: F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(300)) + off
    at = lambda n: F.timestamp_seconds(F.lit(1704067200) + n.cast("long") * 86400)
    domains = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain")).where("domain <> ''").distinct()
    host, domain, prefix = F.col("host"), F.col("domain"), F.concat("host", F.lit("/en"))
    row = lambda df, name, action, kind, key, n, listed: df.select(F.lit(name).alias("list"), F.lit(action).alias("action"), F.lit(kind).alias("kind"), key.alias("key"), at(n).alias("at"), F.lit(listed).alias("listed"))
    return row(hosts, "abuse", "block", "host", host, day(host, 0), True).union(row(hosts, "abuse", "block", "host", host, day(host, 90), False)).union(row(domains, "trusted", "allow", "domain", domain, day(domain, 0), True)).union(row(domains, "trusted", "allow", "domain", domain, day(domain, 60), False)).union(row(hosts, "paths", "block", "prefix", prefix, day(prefix, 0), True))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by the lists of ``list_changes`` at a fetch day made from its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(365)) * 86400)
    found = url_lists.url_filter(pages.withColumn("fetched", fetched), list_changes(pages))
    day = lambda c: F.floor((F.unix_seconds(c) - 1704067200) / 86400)
    return found.withColumns({"fetched": day("fetched"), "valid_from": day("valid_from")})  # days of 2024


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every whole text and of its lines. The given texts are no whole licenses: only lines hit there; the tests hold whole ones."""
    known = spark.createDataFrame(licenses.known_texts(), "license_id string, text string")
    found = licenses.license_scan(table(spark, sf_dir, "documents"), known)
    return found.withColumn("notices", F.array_join("notices", ","))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document within the default limit of bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    own = ranks()
    return tokens.digests(tokens.decode(tokens.encode(table(spark, sf_dir, "documents"), **own), **own))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with cutoffs certified on ``labels``."""
    found = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("rules_failed", F.array_join("rules_failed", ","))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document."""
    return secrets.span_columns(secrets.secret_scan(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, three words and 90 percent."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    return pii.span_columns(pii.pii_spans(table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 rows per language: every step of every order of the five filters."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all texts as files of ids in the shared folder, reads them back and sums what was read."""
    import public_tokenizers

    folder = f"{Scratch(spark, 'token-files').root}/ids"
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.document_sums(token_files.read_token_files(spark, folder))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all texts, of which a tenth by the digest of the id gets a run planted, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.run_digests(periodic.periodic_runs(docs.withColumn("text", periodic.planted(docs.doc_id, docs.text))))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_url_lists, op3_license_scan, op4_main_text, op5_byte_bpe, op6_extendible_shards, op7_quality_rules, op8_secret_scan, op9_ngram_jaccard, op10_pii, op11_filter_audit, op12_token_files, op13_periodic_runs)}
