import base64
import random

import pytest
from conftest import SMALL, rows_of

from lontar.llm import bpe, grouped_splits, leaks, prose
from lontar.runtime import table

DOCS = "doc_id long, text string, lang string, language string, ids string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "id", "x", "y") for i, t in enumerate(texts)], DOCS)


def test_ids_equal_a_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "Pasal 3.\r\n\tx", "<|endoftext|>", "東京 \U0001f600 é", "a" * 3000, "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(4000))]
    texts += [r.text for r in table(spark, SMALL, "documents").collect()]
    got = {r.doc_id: r.ids for r in bpe.encode(documents(spark, texts).repartition(3)).collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents(spark, texts))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert rows_of(bpe.encode(documents(spark, []))) == []


CASES = "case_id string, prompt string, reference_answer string, part string"


def test_leaks_against_windows(spark):
    rng = random.Random(5)
    words = [f"kata{i}" for i in range(12)]
    prompts = [[rng.choice(words) for _ in range(40)] for _ in range(6)] + [["a"] * 14, ["a"] * 16]
    cases = spark.createDataFrame([(f"c{i}", " ".join(p), None if i % 2 else " ".join(reversed(p)), "") for i, p in enumerate(prompts)], CASES)
    texts, inside = [], []
    for n in range(40):
        p = prompts[rng.randrange(8)]
        size = rng.randrange(1, len(p) + 1)
        at = rng.randrange(len(p) - size + 1)
        body = [rng.choice(words) for _ in range(5)] + p[at : at + size] + [rng.choice(words) for _ in range(5)]
        inside.append(body)
        texts.append(rng.choice((",\n", " - ", "  "))[:].join(w.upper() if rng.random() < 0.3 else w for w in body))
    found = rows_of(leaks.leaks(documents(spark, [*texts, None, ""]), cases).select("doc_id", "case_id").distinct())
    wanted = set()
    for d, body in enumerate(inside):
        have = {tuple(body[i : i + 15]) for i in range(len(body) - 14)}
        for c, p in enumerate(prompts):
            parts = [p] + ([] if c % 2 else [p[::-1]])
            if any(tuple(x[i : i + 15]) in have for x in parts for i in range(len(x) - 14)):
                wanted.add((d, f"c{c}"))
    assert found == sorted(wanted, key=repr)
    few = rows_of(leaks.leaks(documents(spark, texts), cases, max_chars=300).select("doc_id", "case_id").distinct())
    assert few == found


def longest_runs(doc, part, least):
    """Every maximal run of words that both have, from `least` words; overlapping ones joined."""
    runs = set()
    for i in range(len(doc)):
        for j in range(len(part)):
            if doc[i] == part[j] and (i == 0 or j == 0 or doc[i - 1] != part[j - 1]):
                n = 0
                while i + n < len(doc) and j + n < len(part) and doc[i + n] == part[j + n]:
                    n += 1
                if n >= least:
                    runs.add((i, i + n))
    out = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@pytest.mark.parametrize("words", [3, 4, 5, 15])
def test_passages_against_all_runs(words):
    rng = random.Random(words)
    for _ in range(150):
        alphabet = "abcdefgh"[: rng.randrange(1, 9)]
        parts = [("c%d" % i, "prompt", " ".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 50)))) for i in range(3)]
        doc = [rng.choice(alphabet + "z") for _ in range(20)]
        for _, _, text in parts:
            listed = text.split()
            at = rng.randrange(len(listed) + 1)
            doc += listed[at : at + rng.randrange(1, 40)] + [rng.choice(alphabet)]
        found = leaks.PassageScanner(tuple(parts), words).hits(" ".join(doc))
        wanted = {case: [("prompt", a, b) for a, b in longest_runs(doc, text.split(), words)] for case, _, text in parts}
        assert dict(found) == {case: spans for case, spans in wanted.items() if spans}


@pytest.mark.parametrize("before", ["Awal: ", "İ ", "e\u0301 ", "\u1112\u1161\u11ab é ", "İİe\u0301\u0323 ﬁ Å ", "ΑΣ "])
def test_leak_offsets_in_the_original(before):
    passage = " ".join(f"kata{i}" for i in range(18)) + " ca\u0301t İx akhir"
    scanner = leaks.PassageScanner((("c", "prompt", passage),))
    text = before + passage.upper().replace(" ", ",\n") + " lain."
    ((part, first, last),) = scanner.hits(text)["c"]
    places = scanner.places(text)
    assert text[places[first][0] : places[last - 1][1]] == passage.upper().replace(" ", ",\n")
    assert leaks.folded(text)[0].replace("ς", "σ") == leaks.composed(text).lower().replace("ς", "σ")


def test_leak_offsets(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    cases = spark.createDataFrame([("c", passage, None, "")], CASES)
    text = "Awal: " + passage.replace(" ", ",\n") + " akhir."
    row = leaks.leaks(documents(spark, [text]), cases).first()
    assert text[row.start : row.end] == passage.replace(" ", ",\n")
    assert rows_of(leaks.leaks(documents(spark, []), cases)) == []
    assert rows_of(leaks.leaks(documents(spark, [text]), spark.createDataFrame([], CASES))) == []


WHO = "pemilik pemohon nelayan bendahara notaris pedagang penguji pengemudi".split()
WHAT = "mencatat menyimpan melaporkan menguji memeriksa menyerahkan".split()
THING = "barang surat kartu denah laporan katalog jaminan manifes segel".split()
PLACE = [a + b for a in ("Ka", "Lo", "Mi", "Su") for b in ("bang", "rete", "dulo", "nawi", "tari", "puse", "gima", "hore", "lane", "joti")]


def prose_of(n, seed=0):
    rng = random.Random(seed)
    return "".join(f"{rng.choice(WHO).title()} wajib {rng.choice(WHAT)} {rng.choice(THING)} yang disimpan di {rng.choice(PLACE)} dan dikelola oleh {rng.choice(WHO)} dalam waktu {rng.randrange(2, 60)} hari. " for _ in range(n))


SPANISH = (
    "El propietario del almacén debe presentar el informe anual en la oficina dentro de treinta días, si el permiso no se retira. Cada socio puede renovar "
    "el contrato de arrendamiento con una copia firmada. La comisión no puede rechazar las solicitudes que se entregan con los documentos necesarios. Los "
    "inspectores visitan las bodegas del puerto una vez por semana y escriben un resumen de lo que encuentran. "
)
PROSE = prose_of(1)
LONG = prose_of(8)
KINDS = {
    LONG: None,
    LONG.upper(): None,
    "\n".join(LONG[i : i + 60] for i in range(0, len(LONG), 60)): None,
    LONG + "\n- peta\n- izin\n- dana\n": None,
    "\n".join(f"{i}) Nama {p}" for i, p in enumerate(PLACE)): "list",
    "\n".join(f"- Lahan {p}" for p in PLACE): "list",
    "\n\n".join(f"{p}, Lahan" for p in PLACE): "list",
    PROSE + "\n" + "\n".join(f"* kartu {p}" for p in PLACE): "list",
    "Uraian;2000;2001\n" + "\n".join(f"izin {i};{i * 37};{i * 91}" for i in range(30)): "table",
    "\n".join(f"| izin {i} | {i * 37} | {i * 91} |" for i in range(30)): "table",
    "\n".join(f"izin {i}\t{i * 37}\t-" for i in range(30)): "table",
    "<table>\n" + "\n".join(f"<tr><td>izin</td><td>{i * 37}</td></tr>" for i in range(30)) + "\n</table>": "table",
    " ".join(LONG.replace(" ", "")): "junk",
    "Beranda | Cari\n" * 60: "junk",
    "\n".join(SPANISH[i : i + 55] for i in range(0, len(SPANISH), 55)): None,
    PROSE * 30: "junk",
    prose_of(2000, 7): None,
    "ha" * 200: "junk",
    "$%>>-$-)?==!.#=](>$(=(|],^)&$}$}}#={&" * 10: "junk",
    "Ã¢â‚¬Ð¾ÑÃ¢â‚¬Ã¢â‚¬ï¿½ï¿½Ã¼ï¿½Ð¾ÑÐ¾Ñ " * 20: "junk",
    None: None,
    "": None,
    " \n ": None,
}


def test_kinds(spark):
    real = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    texts = [*KINDS, *real]
    rows = {r.doc_id: r for r in prose.judged(documents(spark, texts).repartition(4)).collect()}
    assert {t: None if rows[i].kind == "prose" else rows[i].kind for i, t in enumerate(KINDS)} == KINDS
    one = rows[4]
    assert abs(sum(one[f"part_{s}"] for s in prose.STATISTICS) - one.distance) < 1e-6 * one.distance


def of_kind(kind, n, seed):
    rng = random.Random(f"{kind} {seed}")
    names = ["".join(rng.choice(("ka", "lo", "mi", "su", "ret", "na", "du", "wi", "bang")) for _ in range(3)).title() for _ in range(n)]
    if kind == "list":
        return "\n".join(f"- Lahan {x}" for x in names)
    if kind == "table":
        return "\n".join(f"| izin {x} | {rng.randrange(9999)} | {rng.randrange(99)} |" for x in names)
    if kind == "junk":
        return "\n".join("".join(rng.choice("$%>-)?=!.#](|^&}{~@xq7") for _ in range(60)) for _ in range(n))
    return prose_of(n, f"prose {seed}")


def test_kinds_at_every_length(spark):
    """A document keeps its kind when as much again of the same kind is added."""
    cases = [(kind, n, of_kind(kind, n, 1) + "\n" + (of_kind(kind, n, 2) if twice else "")) for kind in ("prose", "list", "table", "junk") for n in (3, 4, 6, 9, 20, 45, 150) for twice in (False, True)]
    real = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    kinds = {r.doc_id: r.kind for r in prose.judged(documents(spark, [t for *_, t in cases] + real).repartition(4)).collect()}
    assert [(kind, n, kinds[i]) for i, (kind, n, _) in enumerate(cases)] == [(kind, n, kind) for kind, n, _ in cases]


def test_parts_of_a_batch():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    k = len(prose.STATISTICS)
    means = {"id": rng.normal(size=k), None: rng.normal(size=k)}
    inverses = {a: (lambda m: m @ m.T)(rng.normal(size=(k, k))) for a in means}
    xs = [list(rng.normal(size=k)) if i % 4 else None for i in range(30)]
    languages = [("id", "en", None)[i % 3] for i in range(30)]
    distance, parts = prose.ProseModel(means, inverses).parts(pd.Series(languages), pd.Series(xs))
    for a, x, d, p in zip(languages, xs, distance, parts):
        key = a if a == "id" else None
        away = None if x is None else np.array(x) - means[key]
        assert (d is None) == (x is None) and (x is None or np.isclose(d, away @ inverses[key] @ away) and np.isclose(sum(p), d))
    assert prose.ProseModel({}, {}).parts(pd.Series(["id"]), pd.Series([xs[1]])) == ([None], [None])


def test_statistics_edges(spark):
    assert rows_of(prose.judged(documents(spark, []))) == []
    few = prose.judged(documents(spark, [None, "", PROSE, PROSE, prose_of(5000)])).collect()
    assert {r.doc_id: r.kind for r in few} == {0: None, 1: None, 2: "prose", 3: "prose", 4: "prose"}


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in pairs:
        if k and a:
            parent[find(("a", a))] = find(("k", k))
    groups = {}
    for k in {k for k, a in pairs if k and a}:
        groups.setdefault(find(("k", k)), []).append(k)
    return sorted((k, min(g)) for g in groups.values() if len(g) > 1 for k in g)


@pytest.mark.parametrize("seed", range(2))
def test_links(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([None, *(f"k{i}" for i in range(40))]), rng.choice([None, *(f"a{i}" for i in range(60))])) for _ in range(70)]
    pairs += [(f"z{i:03}", f"c{i:03}") for i in range(60)] + [(f"z{i + 1:03}", f"c{i:03}") for i in range(60)]
    df = spark.createDataFrame(pairs, "key string, answer string").repartition(3)
    assert rows_of(grouped_splits.linked_keys(df)) == components(pairs)


def test_links_empty(spark):
    assert rows_of(grouped_splits.linked_keys(spark.createDataFrame([], "key string, answer string"))) == []


def test_assignment_keeps_groups_and_shares(spark):
    qa, corpus = table(spark, "/root/testdata/sf0.01", "qa_sft"), table(spark, "/root/testdata/sf0.01", "corpus")
    rows = grouped_splits.records(qa, corpus)
    groups = grouped_splits.linked_keys(rows.select("key", "answer").distinct())
    grouped = grouped_splits.with_groups(rows, groups)
    assert grouped.count() == rows.count()
    splits = grouped_splits.assign(grouped, {"train": 0.8, "validation": 0.08, "test": 0.12})
    assert splits.groupBy("group_key").count().where("count > 1").count() == 0
    assert splits.agg({"rows": "sum"}).first()[0] == rows.count()
    got = {r[0]: r[1] / rows.count() for r in splits.groupBy("split").sum("rows").collect()}
    assert abs(got["train"] - 0.8) < 0.02 and abs(got["validation"] - 0.08) < 0.02 and abs(got["test"] - 0.12) < 0.02
    # every key and every answer stands in one split
    placed = grouped.join(splits, "group_key").select("table_name", "id", "split").join(rows, ["table_name", "id"])
    for c in ("key", "answer"):
        assert placed.where(f"{c} is not null").groupBy(c).agg({"split": "max"}).count() == placed.where(f"{c} is not null").select(c, "split").distinct().count()
    empty = grouped_splits.with_groups(rows.limit(0), groups.limit(0))
    assert rows_of(grouped_splits.assign(empty, {"train": 1.0})) == []


def test_every_label_is_spread_like_the_plan(spark):
    """More labels than any list could hold, one group of a tenth of all rows, one that fills a label."""
    plan = {"train": 0.8, "validation": 0.08, "test": 0.12}
    rows = spark.range(300 * 120).selectExpr("'qa_sft' AS table_name", "cast(id AS string) AS id", "concat('label', id % 300) AS kind", "concat('g', id % 300, '-', (id div 300) div 3) AS group_key")
    big = spark.range(4000).selectExpr("'qa_sft'", "concat('b', id)", "'big'", "if(id < 3600, 'whole', concat('w', id div 2))")
    grouped = rows.unionByName(big.toDF("table_name", "id", "kind", "group_key"))
    splits = grouped_splits.assign(grouped, plan)
    table_ = spark.createDataFrame(list(plan.items()), "split string, share double")
    shares = grouped_splits.label_shares(grouped, splits, table_).collect()
    assert len(shares) == 301 * 3
    assert [r for r in shares if r.label != "big" and r.deviation > 0.03] == []
    got = {r[0]: r[1] / 40_000 for r in splits.groupBy("split").sum("rows").collect()}
    assert all(abs(got[s] - x) < 0.005 for s, x in plan.items())
    assert splits.groupBy("group_key").count().where("count > 1").count() == 0


def test_labels_of_the_tables(spark):
    from lontar.llm.queries import p7_labels

    assert [r for r in p7_labels(spark, "/root/testdata/sf0.01").collect() if r.rows / max(r.share, 1e-9) >= 100 and r.deviation > 0.03] == []


def test_groups_of_rows_without_keys(spark):
    rows = [("qa_sft", "1", "k1", "a"), ("qa_sft", "2", None, "a"), ("qa_sft", "3", None, "b"), ("qa_sft", "4", None, "b"), ("qa_sft", "5", None, None), ("corpus", "5", "k1", None), ("corpus", "6", "k2", None), ("qa_sft", "7", "answer:x", None)]
    df = spark.createDataFrame(rows, "table_name string, id string, key string, answer string")
    got = {(r.table_name, r.id): (r.group_key, r.kind) for r in grouped_splits.with_groups(df, spark.createDataFrame([("k2", "k0")], "key string, group_key string")).collect()}
    assert got == {
        ("qa_sft", "1"): ("k1", "k1"), ("qa_sft", "2"): ("k1", "none"), ("qa_sft", "3"): ("answer:b", "none"), ("qa_sft", "4"): ("answer:b", "none"), ("qa_sft", "5"): ("row:qa_sft:5", "none"),
        ("corpus", "5"): ("k1", "k1"), ("corpus", "6"): ("k0", "k2"), ("qa_sft", "7"): ("answer:x", "answer"),
    }


def test_long_units_repeated(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(7)) for _ in range(3000)]
    unit = [" ".join(rng.choice(words) for _ in range(n)) for n in (400, 400, 150)]
    long = " ".join(prose_of(25, 3).replace(".", "").split())
    texts = ["\n".join([unit[0]] * 6), " ".join([unit[1]] * 50), " ".join([unit[2]] * 20), " ".join([long] * 8)]
    fine = [" ".join(unit), prose_of(60, 5), long]
    real = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    kinds = {r.doc_id: r.kind for r in prose.judged(documents(spark, [*texts, *fine, *real]).repartition(4)).collect()}
    assert [kinds[i] for i in range(len(texts))] == ["junk"] * len(texts)
    assert [kinds[i] == "junk" for i in range(len(texts), len(texts) + len(fine))] == [False] * len(fine)


@pytest.mark.parametrize("n", [20, 21, 35, 310, 900])
def test_passages_against_windows(n):
    rng = random.Random(n)
    unit = [rng.choice("abcdefg") for _ in range(53)]
    for listed in ([rng.choice("ab") for _ in range(n)], (unit * n)[:n]):
        seen = {tuple(listed[i : i + 20]) for i in range(n - 19)}
        assert prose._passages(listed) == pytest.approx(1 - len(seen) / (n - 19))
