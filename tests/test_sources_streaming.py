from __future__ import annotations

import pytest

from phenorank.operators import review
from phenorank.sources import readers, sinks
from phenorank.streaming import selection

OBO = """format-version: 1.2
data-version: hp/releases/2025-01-16

[Term]
id: HP:0000001
name: All

[Term]
id: HP:0000118
name: Some abnormality
def: "A definition." [x:y]
synonym: "Oddity" EXACT []
synonym: "Strange thing" RELATED []
alt_id: HP:0000002
is_a: HP:0000001 ! All

[Term]
id: HP:0000009
name: obsolete thing
is_obsolete: true
replaced_by: HP:0000118

[Typedef]
id: part_of
"""
HPOA = "#description: x\n#version: 2025-01-16\ndatabase_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\tsex\tmodifier\taspect\tbiocuration\nDX:1\tA\t\tHP:0000118\tR\tPCS\t\t1/2\t\t\tP\tc\nDX:1\tA\tNOT\tbad\tR\tPCS\t\t\t\t\tP\tc\n"


def test_obo(spark, tmp_path):
    path = tmp_path / "x.obo"
    path.write_text(OBO)
    got = {r.hpo_id: r for r in readers.obo_terms(spark, str(path)).collect()}
    assert set(got) == {"HP:0000001", "HP:0000118", "HP:0000009"}
    r = got["HP:0000118"]
    assert (r.parents, r.synonyms, r.definition, r.alt_ids) == (["HP:0000001"], ["Oddity", "Strange thing"], "A definition.", ["HP:0000002"])
    assert got["HP:0000009"].is_obsolete and got["HP:0000009"].replaced_by == "HP:0000118" and not r.is_obsolete
    assert readers.obo_version(spark, str(path)) == "hp/releases/2025-01-16"


def test_hpoa(spark, tmp_path):
    path = tmp_path / "x.hpoa"
    path.write_text(HPOA)
    assert [(r.database_id, r.hpo_id, r.frequency_raw) for r in readers.hpoa(spark, str(path), strict=False).collect()] == [("DX:1", "HP:0000118", "1/2")]
    with pytest.raises(Exception, match="not a term id"):
        readers.hpoa(spark, str(path)).collect()
    assert readers.hpoa_version(spark, str(path)) == "2025-01-16"
    headless = tmp_path / "y.hpoa"
    headless.write_text("DX:2\tB\t\tHP:0000001\tR\tE\t\t\t\t\tP\tc\n")
    assert readers.hpoa(spark, str(headless)).collect()[0].database_id == "DX:2"


def test_tables(spark, tmp_path):
    genes = tmp_path / "g.tsv"
    genes.write_text("ncbi_gene_id\tgene_symbol\tassociation_type\tdisease_id\n1\tabc\tstrong\tDX:1\n2\t\tstrong\tDX:1\n")
    assert [(r.profile_id, r.gene, r.evidence_type) for r in readers.gene_associations(spark, str(genes)).collect()] == [("DX:1", "ABC", "strong")]
    xref = tmp_path / "x.tsv"
    xref.write_text("concept_id\tomim_id\torpha_id\nK:1\tOMIM:1\tORPHA:1\n")
    assert readers.concepts(spark, str(xref)).count() == 3
    xref.write_text("concept_id\tomim_id\torpha_id\nK:1\tOMIM:1\t\nK:2\tOMIM:1\t\n")
    with pytest.raises(ValueError):
        readers.concepts(spark, str(xref))
    cat = tmp_path / "c.csv"
    cat.write_text("HPO_ID,Name\nhp_0000001,All\nHP:0000002,obsolete x\nzzz,Bad\n")
    assert [(r.hpo_id, r.name) for r in readers.catalog_csv(spark, str(cat)).collect()] == [("HP:0000001", "All")]
    lex = tmp_path / "l.csv"
    lex.write_text("hpo_id,root_phrase_vi,synonyms_vi,review_status\nHP:0000001,a,b|c,approved\nHP:0000002,d,,draft\n")
    with pytest.raises(ValueError):
        readers.lexicon_csv(spark, str(lex))
    assert readers.lexicon_csv(spark, str(lex), allow_unreviewed=True).count() == 4


def test_strict_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 1, "a": 2}\n[1]\n{"a": NaN}\n{bad\n')
    good, bad = readers.strict_jsonl(spark, str(path))
    assert good.count() == 1 and bad.count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "mention_id bigint, mention_text string")
    sinks.write_review_csv(df, str(tmp_path / "sheet"))
    back = sinks.read_review_csv(spark, str(tmp_path / "sheet"), "mention_id bigint, mention_text string")
    assert sinks.digest(back) == sinks.digest(df) != sinks.digest(df.limit(1))
    pin = sinks.save_artifact(str(tmp_path / "model"), {"model": {"w": [1.5]}})
    assert sinks.load_artifact(str(tmp_path / "model"), pin) == {"model": {"w": [1.5]}}
    with pytest.raises(FileExistsError):
        sinks.save_artifact(str(tmp_path / "model"), {})
    (tmp_path / "model/model.json").write_text("{}")
    with pytest.raises(ValueError):
        sinks.load_artifact(str(tmp_path / "model"))
    m = spark.createDataFrame([("R", 0, "x", "present"), ("R", 5, "y", "absent")], "report_id string, span_start int, mention_text string, assertion string")
    assert '"role":"assistant"' in sinks.chat_records(m, "s").collect()[0].value


def test_stream_equals_batch(spark, tmp_path):
    rows = [("C", "T", "PRESENT", 2, 1), ("C", "T", "ABSENT", 3, 2), ("C", "T", "PRESENT", 4, 3), ("C", "U", "ABSENT", 1, 4), ("C", None, "ABSENT", 1, 5)]
    df = spark.createDataFrame(rows, "case_id string, term string, status string, at bigint, seq bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    q = selection.selection_stream(stream).writeStream.format("memory").queryName("selected").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.case_id, r.term, r.status, r.sources, r.duplicates, r.conflicts)
    assert sorted(map(key, spark.table("selected").collect())) == sorted(map(key, review.selection_state(df).collect())) == [("C", "T", "PRESENT", 3, 1, 1), ("C", "U", "ABSENT", 1, 0, 0)]
