import unicodedata

from conftest import SMALL, rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lontar.llm import copies, lookalikes
from lontar.runtime import table

FIELDS = "entry_id long, istilah string, pengertian string, undang_undang string, row string, form string"


def entries(spark, rows):
    return copies.from_table(spark.createDataFrame([(i, a, b, c, "x", "y") for i, a, b, c in rows], FIELDS))


def brute(rows):
    seen, out = {}, []
    for i, *fields in sorted(rows):
        k = tuple(copies.canonical(f) for f in fields)
        if k in seen and i != seen[k]:
            out.append((i, seen[k]))
        seen.setdefault(k, i)
    return sorted(out, key=repr)


def test_forms(spark):
    rows = [
        (1, "Izin Usaha", "Izin adalah surat.", "UU 1"),
        (2, "IZIN  usaha", "izin: adalah, surat", "UU-1"),
        (3, "Izin Usаha", "I​zin adalah ｓurat.", "UU 1"),
        (4, "Izin Usahà", "Izin adalah surat.", "UU 1"),
        (5, "Izin Usahà", "Izin adalah surat.", "UU 1"),
        (6, None, "", "  "),
        (7, "", None, "..."),
        (8, "Izin", "Usaha Izin adalah surat.", "UU 1"),
        (9, "Izin Usaha", "Izin adalah surat.", "UU 1"),
    ]
    assert rows_of(copies.copies(entries(spark, rows).repartition(4))) == [(2, 1), (3, 1), (5, 4), (7, 6), (9, 1)] == brute(rows)
    kept = {r.keep_id: r.copies for r in copies.records(copies.survivors(entries(spark, rows))).collect()}
    assert kept == {1: 4, 4: 2, 6: 2, 8: 1}


def test_json_order_and_escapes(spark):
    df = spark.createDataFrame([(1, '{"istilah":"a b","pengertian":"c","undang_undang":"d"}'), (2, '{ "undang_undang": "D", "pengertian": "\\u0063", "istilah": "a\\nb", "url": 1 }'), (3, "no json"), (4, None)], "entry_id long, payload string")
    assert rows_of(copies.copies(copies.from_json(df))) == [(2, 1), (4, 3)]


def test_empty_and_long(spark):
    assert rows_of(copies.copies(entries(spark, []))) == []
    long = "kata " * 100_000
    assert rows_of(copies.copies(entries(spark, [(1, long, "x", "y"), (2, long.upper(), "x", "y"), (3, long + "z", "x", "y")]))) == [(2, 1)]


def test_whole_tables_against_brute_force(spark):
    all_ = copies.from_table(table(spark, SMALL, "glossary")).unionByName(copies.from_json(table(spark, SMALL, "glossary_feed")))
    assert rows_of(copies.copies(all_)) == brute([tuple(r) for r in all_.collect()])


def test_classes_are_transitive_and_visible_differences_stay():
    rewrite = lookalikes.plain_rewriter()
    same = ["pasal", "pаsаl", "ｐasal", "pas​al", "рasal", "p­asal"]
    assert {rewrite(x) for x in same} == {"pasal"}
    assert rewrite("е́") == rewrite("é") == rewrite("é") == "é"
    assert rewrite("ﬁat") == "fiat" and rewrite("a b　c") == "a b c"
    for a, b in (("Pasal", "pasal"), ("e", "é"), ("a b", "a  b"), ("a,b", "ab"), ("a\tb", "a b"), ("m²", "m2"), ("½", "1/2")):
        assert rewrite(a) != rewrite(b)
    assert rewrite("") == "" and rewrite(None) is None


def test_frequency_decides():
    counts = {"а": 10, "a": 3}
    assert lookalikes.representatives(counts)["a"] == "а"
    assert "a" not in lookalikes.representatives({"a": 10})
    assert "".join(map(lookalikes.Rewriter(lookalikes.representatives(counts)), ("á", "ａ", "a"))) == "а\u0301аа"


ALPHABET = "aаａαeеéıiіffiﬁﬃsﬅстtjјＪｶﾞ\u0301\u0323\u0308\u3099\u200b\u034f \u00a0\u3000-‑ёйĳǆÅ\u212b"


def decided(x):
    """The form of a text by a plainer path: decomposed, every code point by its class, spellings written out."""
    lead = {}
    for group in lookalikes.lookalike_classes():
        spelt = [m for m in group if len(m) > 1]
        for m in group:
            if len(m) == 1:
                lead[m] = spelt[0] if spelt else min(group, key=lambda c: (not c.isascii(), c))
    x = "".join(c for c in x if c not in lookalikes.INVISIBLE)
    return "".join(lead.get(c, c) for c in unicodedata.normalize("NFD", x))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=14), st.dictionaries(st.sampled_from(sorted(set(ALPHABET) - set(lookalikes.INVISIBLE))), st.integers(0, 20), max_size=12))
def test_rewriting_ends_and_gives_one_form_per_class(x, counts):
    rewrite = lookalikes.Rewriter(lookalikes.representatives(counts))
    once = rewrite(x)
    assert rewrite(once) == once
    assert decided(once) == unicodedata.normalize("NFD", decided(x))
    # whatever is written with the class's other members comes out alike
    for group in lookalikes.lookalike_classes():
        for m in group:
            if m in x and not any(map(unicodedata.combining, m)):
                assert {rewrite(x.replace(m, other)) for other in group if unicodedata.normalize("NFD", other) == other} == {once}
    assert rewrite(unicodedata.normalize("NFC", x)) == rewrite(unicodedata.normalize("NFD", x)) == once or any(c in lookalikes.INVISIBLE for c in x)


def test_mixed_scripts_end():
    for counts, text in (({"е": 10, "e": 3, "é": 5}, "cafe\u0301 и …"), ({"ｅ": 10, "é": 5}, "e\u0301")):
        rewrite = lookalikes.Rewriter(lookalikes.representatives(counts))
        assert rewrite(rewrite(text)) == rewrite(text)


def test_pairs(spark):
    rows = [(1, "pasal satu"), (2, "pаsal satu"), (3, "pasal satu"), (4, "Pasal satu"), (5, None), (6, ""), (7, "​"), (8, "pasal\u00a0satu"), (9, "ра\u200bsal satu")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("look", F.lit(1))
    wanted = [(a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and lookalikes.plain_rewriter()(x) == lookalikes.plain_rewriter()(y)]
    counts = lookalikes.member_counts([(df, "t")])
    assert rows_of(lookalikes.same_look(df.repartition(3), ["t"], counts)) == wanted
    assert {(1, 2), (1, 8), (2, 3), (2, 9), (3, 8)} - set(wanted) == set()
    links = {}
    for pair in wanted:
        for i in pair:
            links[i] = links.get(i, 0) + 1
    assert rows_of(lookalikes.same_look_rows(df.repartition(3), ["t"], counts)) == sorted((i, 1, n) for i, n in links.items())
    empty = spark.createDataFrame([], "id long, t string")
    nothing = lookalikes.member_counts([(empty, "t")])
    assert rows_of(lookalikes.same_look(empty, ["t"], nothing)) == rows_of(lookalikes.same_look_rows(empty, ["t"], nothing)) == []


def test_one_mapping_for_all_fields(spark):
    a, b = spark.createDataFrame([("аа",)], "t string"), spark.createDataFrame([("aaa",), (None,)], "u string")
    assert lookalikes.representatives(lookalikes.member_counts([(a, "t"), (b, "u")]))["а"] == "a"
