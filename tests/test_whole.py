"""The operators do the whole job: nothing is left out by groups, filters, windows, lists of signs or candidates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

import __spark_entry__ as entry
from phenorank.functions import scalars
from phenorank.operators import text
from phenorank.plans import base

SMALL = "/root/testdata/sf0.001"


def test_entries_of_a_place_meet(spark):
    cat = spark.read.parquet(f"{SMALL}/hpo_catalog_vi.parquet")
    places = {r.id: r.place for r in cat.select(F.upper(F.trim("id")).alias("id"), F.regexp_extract(F.lower("en"), r" of the ([a-z ]+)$", 1).alias("place")).where("id is not null and place <> ''").collect()}
    links = {r.child: r.parent for r in base.links(spark, SMALL).collect() if r.child in places and r.parent.startswith("PLACE:")}
    assert links.keys() == places.keys() and len(set(links.values())) == len(set(places.values()))


def plain(value: str) -> str:
    """The reference's normalisation."""
    value = unicodedata.normalize("NFKC", value).casefold().replace("đ", "d")
    value = "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")
    return re.sub(r"[^a-z0-9:+]+", " ", value).strip()


def test_scan_of_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if r.text is not None]
    names = {(r.id, plain(r.en)) for r in spark.read.parquet(f"{SMALL}/hpo_catalog_vi.parquet").select("id", "en").collect() if r.en is not None}
    want = {(d, i) for d, t in docs for body in [f" {plain(t)} "] for i, n in names if n and f" {n} " in body}
    got = entry.queries()["dictionary_scan"](spark, SMALL).collect()
    assert {(r.doc_id, r.term) for r in got} == want and len(got) == len(want)
    assert {d for d, _ in want} & {d for d, t in docs if not t.isascii()}


def test_every_mention_is_normalised(spark):
    rows = spark.read.parquet(f"{SMALL}/phenotype_mention.parquet").select("mention_id", "mention_text").collect()
    want = {(r.mention_id, plain(r.mention_text)) for r in rows if r.mention_text is not None}
    got = entry.queries()["normalise_text"](spark, SMALL).collect()
    assert {(r.mention_id, r.normal) for r in got} == want and len(got) == len(want)
    odd = [("Ｄｅｎｓｅ ﬁngers ², Straße",), ("ÐẦU\u0309 a\u0301\u200bb",), ("  ",), (None,)]
    got = spark.createDataFrame(odd, "x string").select("x", scalars.normalize_text(F.col("x")).alias("y")).collect()
    assert all(r.y == (None if r.x is None else plain(r.x)) for r in got) and got[0].y == "dense fingers 2 strasse"


def test_phrases_of_any_length(spark):
    words = [f"w{k}" for k in range(40)]
    lex = spark.createDataFrame([("L", " ".join(words[3:33])), ("M", " ".join(words[20:33])), ("N", " ".join([*words[3:32], "x"]))], "term string, phrase string")
    hits = text.dictionary_scan(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"), lex, "doc_id", "text")
    assert sorted((r.term, r.first, r.last) for r in hits.collect()) == [("L", 3, 32), ("M", 20, 32)]
    assert text.dictionary_scan(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), lex.limit(0), "doc_id", "text").count() == 0
