from cases import words
from pyspark.sql import functions as F

from wardline.llm import quality


def plain(text):
    """The counts of a text, counted by hand."""
    found = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    places = {}
    for i in range(len(found) - 2):
        places.setdefault(tuple(found[i:i + 3]), []).append(i)
    covered = {p + k for at in places.values() if len(at) > 1 for p in at for k in range(3)}
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(rows):
    for r in rows:
        want = plain(r["text"])
        assert tuple(r[n] for n in NAMES) == want, r["doc_id"]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_counts(documents):
    check(quality.judge(documents).collect())


def test_overlapping_windows(spark):
    texts = ["a b c a b c a", "a a a a", "a b a b a b", "x y z q x y z q r", "a b", "", None,
             "l\nl\n l\nl \n\n\nl"]
    check(quality.judge(spark.createDataFrame(
        [(i, t, "en", "s") for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string")).collect())


def test_junk_leaves_and_clean_stays(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(80)), "en", "s")
             for i in range(200)]
    junk = [(1000 + i, " | ".join(f"#{(i + k * k) % 89}%%" for k in range(80)), "en", "s")
            for i in range(10)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert kept == {r[0] for r in clean}


def clean_texts(n):
    return [(i, "\n".join(" ".join(f"word{i}x{k}y{j}" for j in range(6)) for k in range(15)), "en", "s")
            for i in range(n)]


def test_each_coordinate_rejects_alone(spark):
    clean = clean_texts(200)
    lines = [(1000 + i, "\n".join(" ".join(f"word{i}z{k}y{j}" for j in range(6)) + "\nshare\nprint"
                                  for k in range(20)), "en", "s") for i in range(3)]
    phrase = " ".join(f"word{k}r" for k in range(24))
    repeats = [(2000 + i, " ".join(f"word{i}u{k}" for k in range(53)) + f" {phrase} {phrase}", "en", "s")
               for i in range(3)]
    one_of_three = [(3000, "\n".join(["word again", "word again", clean[0][1].replace("\n", " ")]),
                     "en", "s")]
    docs = spark.createDataFrame(clean + lines + repeats + one_of_three,
                                 "doc_id long, text string, lang string, source string")
    judged = quality.judge(docs).collect()
    assert not any(r["base_failed"] for r in judged)
    assert all(r["n_repeat_words"] == 0 for r in judged if 1000 <= r["doc_id"] < 2000)
    assert all(r["n_dup_lines"] == 0 for r in judged if 2000 <= r["doc_id"] < 3000)
    assert {r["doc_id"] for r in judged if r["kept"]} == {r[0] for r in clean + one_of_three}


def test_many_copies_of_junk_leave(spark):
    clean = clean_texts(120)
    junk = " | ".join(f"#{(k * k + k) % 8999}%%" for k in range(80))
    docs = [(*r[:3], f"s{share}") for share in (35, 45) for r in clean] + [
        (10_000 + i, junk, "en", f"s{share}") for share in (35, 45)
        for i in range(len(clean) * share // (100 - share))]
    judged = quality.judge(spark.createDataFrame(
        docs, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in judged)
    for source in ("s35", "s45"):
        assert {r["doc_id"] for r in judged if r["kept"] and r["source"] == source} == {
            r[0] for r in clean}


def test_the_last_step_counts_by_the_part_needed(spark):
    rows = spark.createDataFrame([(0, 3), (1, 4), (2, 3)], "step long, n long").withColumn(
        "g", F.lit(1))
    assert [(r["step"], r["part"]) for r in quality.nearest(rows, ["g"], 0.5).orderBy(
        "step").collect()] == [(0, 1.0), (1, 0.5)]


def test_edges(edges, nothing):
    check(quality.judge(edges).collect())
    left = quality.filter_quality(edges)
    assert left.columns == edges.columns and left.where("n_words NOT LIKE 'n_words-%'").count() == 0
    assert quality.filter_quality(nothing).count() == 0


def test_many_rejections_are_judged_again(spark, documents, edges, monkeypatch):
    """Rejections too many for a broadcast of 20 MB neither pass the driver nor shuffle texts."""
    assert quality.MOST_GONE <= 100_000
    names = ["doc_id", "text", "lang", "source"]
    odd = documents.select(names).union(edges.select(names))
    few = sorted(quality.filter_quality(odd).collect(), key=repr)
    monkeypatch.setattr(quality, "MOST_GONE", 0)
    again = quality.filter_quality(odd)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert sorted(again.collect(), key=repr) == few and 0 < len(few) < odd.count()
    assert "SortMergeJoin" not in plan and "LeftAnti" not in plan
    # The plain rules are not moved below the join, where counts would be taken twice.
    assert plan.count("Filter (") == 1 and plan.index("Filter (") < plan.index("Join")
