import re

from conftest import SF001
from ulasan.llm import quality, secret_scan

from .test_corpus import brute as brute_spans
from .test_dedup import brute_components, brute_fingerprint
from .test_lines import brute as brute_lines
from .test_tokens import check_packing


def test_registered():
    from __spark_entry__ import queries
    names = set(queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


def simhash_brute(rows):
    ids = {}
    for i, t in rows:
        ids[i] = brute_fingerprint(t)
    links = [(a, b) for a in ids for b in ids if a < b and bin(ids[a] ^ ids[b]).count("1") <= 2]
    root = brute_components(ids, links)
    return sorted((i, t) for i, t in rows if root[i] == i)


def masked(t):
    at, got = 0, []
    for s, _, e in brute_spans(t)[1]:
        if s >= at:
            got += [t[at:s], secret_scan.MASK]
        at = max(at, e)
    return "".join(got) + t[at:]


def test_stages_against_brute_force(llm):
    import corpus_pipeline
    docs = llm.read.parquet(f"{SF001}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "secret_scans", "packing"]

    def rows(df):
        assert df.columns == docs.columns
        return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    good = stage["quality_classifier"](llm, docs, SF001).persist()
    stats, model = quality.train(docs, llm.read.parquet(f"{SF001}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score_statistics(stats, model).collect()}
    assert [i for i, _ in rows(good)] == sorted(i for i, s in scores.items() if s >= 0.3)
    lines = stage["line_dedup"](llm, good, SF001).persist()
    assert sorted((str(i), t) for i, t in rows(lines)) == brute_lines(rows(good))
    single = stage["simhash_near_dedup"](llm, lines, SF001).persist()
    assert rows(single) == simhash_brute(rows(lines))
    clean = stage["secret_scans"](llm, single, SF001).persist()
    assert rows(clean) == sorted((i, masked(t)) for i, t in rows(single))
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    kept = rows(clean)
    number = {i: k for k, (i, _) in enumerate(kept)}
    from pyspark.sql import Row
    pieces = [Row(**{**r.asDict(), "doc_id": number[r.doc_id]}) for r in stage["packing"](llm, clean, SF001).collect()]
    check_packing(pieces, [t for _, t in kept])
    whole = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(llm, SF001).collect())
    lengths = {}
    for i, s, n, _ in whole:
        lengths[i] = lengths.get(i, 0) + n
    assert set(lengths) == set(number)


def test_stages_on_odd_tables(llm):
    import corpus_pipeline
    rows = [(1, "Hello there world. " * 9, "en", "s", 5), (1, "Hello there world. " * 9, "en", "s", 5), (None, None, None, None, None), (None, "no id", "x", None, 5),
            (3, "", "en", "s", 0), (4, "  \n\n", "en", "s", 4), (5, "password = abcdefgh " + "w" * 50000, "en", "s", None), (1, "other text, same id", "en", "s", 1)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", docs_extra())
    for table in (docs, docs.limit(0)):
        df = table
        for name, f in corpus_pipeline.STAGES:
            df = f(llm, df, SF001).persist()
            n = df.count()
            if name != "packing":
                assert df.columns == docs.columns
            if name == "simhash_near_dedup":
                assert n == df.select("doc_id", "text").distinct().count()
        assert (n > 0) == (table is docs)
    again = dict(corpus_pipeline.STAGES)["secret_scans"](llm, docs, SF001).collect()
    assert any(re.match(r"\[SECRET\] w+$", r.text or "") and r.n_chars == 9 + 50000 for r in again)


def docs_extra():
    from pyspark.sql import functions as F
    return F.lit("clash")
