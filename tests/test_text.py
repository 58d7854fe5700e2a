import random

from pyspark.sql import functions as F

from pyref import clean
from ulasan.functions.text import clean_and_filter, clean_text_df, term_counts, uni_bigrams, word_count

GOLDEN = [
    ("&amp;lt;b&gt; enak sekali", "&lt;b> enak sekali", True),
    ("Cek https://t.co/xyz @budi #MBG enak!", "Cek MBG enak!", True),
    ("Mantap.. Ni..", "Mantap Ni", True),
    ("a - - b", "a - b", True),
    ("“Bagus” sekali…", 'Bagus" sekali', True),
    ("'ok'", "ok", False),
    ("\U0001f44d\U0001f44d mantap program ini", "mantap program ini", True),
    ("a@b.com kirim ke sini", "a.com kirim ke sini", True),
    ("bagus\nsekali\r\nya", "bagus sekali ya", True),
    ("\"\"'dua kata'\"\"", "dua kata", True),
    ("gratis—tapi basi", "gratis-tapi basi", True),
    ("　 tepi   kata", "tepi kata", True),
    ("halo @budi_é dan @x", "halo dan", True),
    ("www.a.id/x y z", "y z", False),
    ("ya a", "ya a", False),
    ("abc", "abc", False),
    ("", "", False),
    ("\U0001f600", "", False),
    ("&notit; &copy &#x41;&#65 x &amp</b>", "¬it; © AA x &</b>", True),
]


def test_golden_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "id long, text string")
    got = {r.id: r.c for r in clean_text_df(df, "text", "c").collect()}
    kept = {r.id for r in clean_and_filter(df, "text").collect()}
    for i, (raw, exp, keep) in enumerate(GOLDEN):
        assert got[i] == exp == clean(raw), raw
        assert (i in kept) == keep, raw


def test_random_unicode_matches_python(spark):
    alphabet = list(" \t\n\r 　 \u0085\x1c.-\"'#@&;:/_“”‘’–—…"
                    "\U0001f600‍️⭐abcxyzéß1") + ["&amp;", "&lt;", "http://", "www.", "&copy",
                                                                          "&#39;", "&nbsp;", "&#x1F600;"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = clean_text_df(df, "text", "c").select("id", "c", word_count("c").alias("wc")).collect()
    for r in out:
        exp = clean(texts[r.id])
        assert r.c == exp, texts[r.id]
        assert r.wc == len(exp.split())


def test_term_counts_equal_counter(spark):
    import re
    from collections import Counter
    texts = ["aa bb aa bb cc", "x", "", "Der Hund, der HUND; und_so 12 12 12", "é é é ü"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: {x.term: x.tf for x in r.tc} for r in
           df.select("id", term_counts(uni_bigrams(F.col("text"))).alias("tc")).collect()}
    for i, t in enumerate(texts):
        tk = re.findall(r"\w{2,}", t.lower())
        exp = Counter(tk + [f"{a} {b}" for a, b in zip(tk, tk[1:])])
        assert got[i] == dict(exp)


def test_long_texts_match_python(spark):
    alphabet = list(" \t\n\r 　 \u0085\x1c.-\"'#@&;:/_“”‘’–—…\U0001f600‍️⭐⌚abcxyzéß01") + \
        ["&amp;", "&lt;", "https://t.co/", "www.", "&copy", "&#39;", "@user", "#tag", "..", " - ", "  "]
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(200, 2000))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.c for r in clean_text_df(df, "text", "c").collect()}
    kept = {r.id for r in clean_and_filter(df, "text").collect()}
    for i, t in enumerate(texts):
        exp = clean(t)
        assert got[i] == exp
        assert (i in kept) == (len(exp.split()) >= 2 and len(exp) >= 5)
