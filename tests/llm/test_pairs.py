import functools
import math
import random

import pandas as pd
from conftest import SMALL, rows_of
from hypothesis import given, settings, strategies as st

from lontar.llm import broken_pairs, overlaps
from lontar.llm.emptiness import is_empty
from lontar.runtime import table

QA = "id string, split string, prompt string, completion string, key string, side int"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=15), st.lists(st.sampled_from("abcde"), max_size=15))
def test_bit_parallel_lcs(a, b):
    assert overlaps.common_in_order(a, b) == lcs(a, b)


def brute(rows):
    out = set()
    for i, s, p, c, *_ in rows:
        for j, t, q, d, *_ in rows:
            if s == "train" and t in ("validation", "test") and not is_empty(c) and not is_empty(d):
                pairs = [(overlaps.words(p), overlaps.words(q)), (overlaps.words(c), overlaps.words(d))]
                if all(10 * lcs(x, y) >= 9 * max(len(x), len(y)) for x, y in pairs):
                    out.add(tuple(sorted((i, j))))
    return sorted(out)


def test_overlaps_lose_nothing(spark):
    rng = random.Random(2)
    vocabulary = [f"kata{i}" for i in range(30)]
    rows = []
    for n in range(120):
        p, c = ([rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        for m in range(rng.randrange(1, 4)):
            q, d = p[:], c[:]
            for x in (q, d):
                for _ in range(rng.randrange(0, 3)):
                    at = rng.randrange(len(x))
                    rng.choice((lambda: x.__setitem__(at, rng.choice(vocabulary)), lambda: x.insert(at, rng.choice(vocabulary)), lambda: x.pop(at) if len(x) > 1 else None))()
            rows.append((f"r{n:03}{m}", rng.choice(("train", "validation", "test", "other", None)), rng.choice((str.upper, str))(", ".join(q)), " ".join(d) + ".", "x", 7))
    rows += [("e1", "train", "a", None, "x", 1), ("e2", "test", "a", "N/A", "x", 1), ("n1", "train", None, "b", "x", 1), ("n2", "test", "", "B!", "x", 1), ("d1", "train", "a", "b", "x", 1), ("d2", "train", "a", "b", "x", 1), ("d3", "test", "A", "b", "x", 1)]
    df = spark.createDataFrame(rows, QA)
    found = rows_of(overlaps.overlaps(df.repartition(5)))
    assert found == brute(rows)
    assert ("n1", "n2") in found and ("d1", "d3") in found and ("d2", "d3") in found
    assert rows_of(overlaps.overlaps(df, ranked_words=3)) == found


def test_long_overlaps_lose_nothing(spark):
    """Records on both sides of the border between the two ways of keying, of all proportions."""
    rng = random.Random(6)
    vocabulary = [f"kata{i}" for i in range(400)]
    rows = []
    for n in range(70):
        p, c = ([rng.choice(vocabulary) for _ in range(rng.choice((1, 8, 40, 55, 60, 66, 110, 130, 300)))] for _ in range(2))
        for m in range(3):
            q, d = p[:], c[:]
            for x in (q, d):
                for _ in range(rng.randrange(0, len(x) // 11 + 2)):
                    at = rng.randrange(len(x))
                    rng.choice((lambda: x.__setitem__(at, rng.choice(vocabulary)), lambda: x.insert(at, rng.choice(vocabulary)), lambda: x.pop(at) if len(x) > 1 else None))()
            rows.append((f"r{n:03}{m}", ("train", "test")[m % 2], " ".join(q), " ".join(d), "x", 7))
    df = spark.createDataFrame(rows, QA)
    wanted = brute(rows)
    assert len(wanted) > 40 and rows_of(overlaps.overlaps(df.repartition(3))) == wanted


def test_keys_grow_with_the_text():
    signer = overlaps.Signer({}, overlaps.SHARE)
    sizes = {(n, m): len(signer.keys([f"p{i}" for i in range(n)], [f"c{i}" for i in range(m)])) for n, m in ((5, 20), (50, 60), (50, 200), (500, 2000), (1000, 5000), (5000, 5000))}
    assert sizes[1000, 5000] == 501 and all(k <= 0.2 * (n + m) + 50 for (n, m), k in sizes.items())


def test_copies_of_a_text(spark):
    """Many copies on both sides: every pair, and one row each."""
    rows = [(f"a{i:03}", "train", "apa isi pasal itu", "pemilik wajib mencatat", "", 0) for i in range(40)] + [(f"b{i:03}", "test", "Apa isi pasal itu?", "Pemilik wajib mencatat.", "", 0) for i in range(30)]
    df = spark.createDataFrame(rows, QA).repartition(5)
    assert overlaps.overlaps(df).count() == 1200
    assert {(r.id[0], r.links) for r in overlaps.overlap_counts(df).collect()} == {("b", 40)}


def test_overlaps_empty_and_long(spark):
    assert rows_of(overlaps.overlaps(spark.createDataFrame([], QA))) == []
    long = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([("a", "train", "p", long, "", 0), ("b", "test", "p", long + " akhir", "", 0)], QA)
    assert rows_of(overlaps.overlaps(df)) == [("a", "b")]


def test_overlaps_of_the_table(spark):
    qa = table(spark, SMALL, "qa_sft").select("id", "split", "prompt", "completion")
    assert rows_of(overlaps.overlaps(qa)) == brute([tuple(r) for r in qa.collect()])


CASES = [
    ("Apa isi Pasal 3?", None, "empty"),
    ("Apa isi Pasal 3?", " \n", "empty"),
    ("Apa isi Pasal 3?", "Jawaban:", "empty"),
    ("Apa isi Pasal 3?", "N/A", "empty"),
    ("Apa isi Pasal 3?", "...", "empty"),
    ("Berapa lama masa berlaku izin gudang?", "30 hari", None),
    ("Pasal berapa yang mengatur izin gudang?", "Pasal 3 ayat (2)", None),
    ("Bolehkah gudang disewakan menurut peraturan itu?", "Tidak diperbolehkan. Pemilik gudang wajib mencatat kartu anggota kepada Badan Taruna selama 3 bulan.", None),
    ("Bolehkah gudang disewakan menurut peraturan itu?", "Pasal 3 tidak memuat ketentuan tentang gudang.", None),
    ("Bolehkah gudang disewakan menurut peraturan itu?", "Maaf, saya tidak bisa membantu soal gudang.", "refusal"),
    ("Bolehkah gudang disewakan menurut peraturan itu?", "Waduh, kalau soal gudang saya angkat tangan", "refusal"),
    ("Bolehkah gudang disewakan menurut peraturan itu?", "Bolehkah gudang disewakan menurut peraturan itu?", "copy"),
    ("Bolehkah gudang disewakan menurut peraturan itu?", "Jawaban: BOLEHKAH GUDANG DISEWAKAN MENURUT PERATURAN ITU", "copy"),
    ("Bagaimana aturan yang berlaku untuk gudang di kota?", "The owner of the warehouse must keep the records within thirty days, unless the permit has been withdrawn.", "language"),
    ("Terjemahkan ke dalam bahasa Inggris: Pemilik gudang wajib mencatat.", "The owner of the warehouse must keep the records within thirty days.", None),
    ("What must the owner of the warehouse do with the records?", "The owner of the warehouse must keep the records within thirty days.", None),
    ("Bagaimana aturan gudang?", "Pemilik gudang wajib mencatat kartu anggota kepada Badan Taruna setelah lewat", "truncated"),
    ("Bagaimana aturan gudang?", "Syaratnya sebagai berikut:\na. kartu anggota;\nb. peta batas; dan", "truncated"),
    ("Bagaimana aturan gudang?", "Pemilik gudang wajib mencatat kartu anggota (sebagaimana dimaksud dalam", "truncated"),
]


def test_defects(spark):
    sample = table(spark, "/root/testdata/sf0.01", "qa_sft").select("id", "prompt", "completion")
    extra = spark.createDataFrame([(f"zz{i}", p, c) for i, (p, c, _) in enumerate(CASES)], "id string, prompt string, completion string")
    found = {r.id: r.defect for r in broken_pairs.defects(sample.unionByName(extra)).where("id like 'zz%'").collect()}
    assert {(p, c): found.get(f"zz{i}") for i, (p, c, _) in enumerate(CASES)} == {(p, c): d for p, c, d in CASES}


def test_defects_held_out(spark):
    """Defects made from clean rows that the field wasn't fitted on are found again."""
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "qa_sft").select("id", "prompt", "completion").orderBy("id").collect()]
    fit, rest = rows[::2], rows[1::2]
    tagger = broken_pairs.PairTagger.fit(fit)
    made = broken_pairs.training_pairs(rest, tagger.extract.ends)
    got = [d for d, _ in tagger.defects([(p, c) for p, c, *_ in made])]
    names = {0: None, 1: "refusal", 2: "copy", 3: "language", 4: "truncated"}
    for tag, name in names.items():
        own = [g == name for g, (_, _, t, _) in zip(got, made) if t == tag]
        assert len(own) > 50 and sum(own) / len(own) > 0.9, (name, sum(own) / len(own))


@functools.cache
def TAGGER():
    rows = pd.read_parquet("/root/testdata/sf0.01/qa_sft.parquet", columns=["id", "prompt", "completion"])
    rows = rows.astype(object).where(rows.notna(), None).sort_values("id").head(broken_pairs.SAMPLE_ROWS)
    return broken_pairs.PairTagger.fit([tuple(r) for r in rows.itertuples(index=False)])


ASKED = "Bolehkah gudang disewakan menurut peraturan itu?"
# Phrasings that the field isn't taught.
REFUSED = (
    "Yang ini skip dulu ya.",
    "Dengan berat hati urusan gudang kami lewati.",
    "Untuk yang satu itu aku nyerah.",
    "Saya rasa lebih bijak kalau saya tidak masuk ke urusan ini.",
    "Bukan kapasitas kami mengulas hal semacam itu.",
    "Duh, nggak sanggup kalau disuruh jelasin soal gudang.",
    "Mohon dimaklumi, kami tidak melayani tanya jawab mengenai gudang.",
    "Saya khawatir tak punya jawaban untuk hal tersebut.",
    "Kami sarankan Anda bertanya langsung kepada notaris saja.",
    "Sebaiknya Anda berkonsultasi dengan pengacara, saya tidak bisa memastikan.",
    "Aku pass untuk topik itu.",
    "Topiknya kelewat rawan, jadi saya diam saja.",
    "Izinkan saya untuk tidak menanggapi hal ini.",
    "Saya tidak dibekali wewenang untuk mengupas persoalan gudang.",
    "Gue kagak ngerti urusan beginian.",
    "Silakan cari informasinya di tempat lain, kami tidak menyediakannya.",
    "Saya hanya program komputer dan tidak boleh memberi pendapat hukum.",
    "Hal itu tidak ingin saya komentari.",
    "Kami belum diperkenankan membuka informasi mengenai gudang.",
    "Maafkan saya, jawaban untuk itu tidak tersedia dari saya.",
)
SOUND = (
    "Badan hukum juga bisa mengajukan permohonan izin gudang kepada kantor.",
    "Permohonan tidak dapat dibahas sebelum pemilik gudang membayar tarif.",
    "Pertanyaan anggota tidak dijawab bila diajukan setelah sidang ditutup.",
    "Permintaan yang terlambat ditolak oleh sistem pendaftaran.",
    "Permohonan yang diajukan lewat tanggal tersebut tidak dilayani oleh loket.",
    "Pemilik gudang tidak diperkenankan menyimpan barang berbahaya.",
    "Tidak ada kewajiban bagi pemilik gudang untuk melapor.",
    "Peraturan tersebut tidak memuat larangan menyewakan gudang.",
    "Keberatan ditolak apabila bukti tidak lengkap.",
    "Pejabat tidak berwenang memberi izin di luar wilayahnya.",
    "Pertanyaan tertulis hanya dijawab oleh ketua sidang.",
    "Anggota yang belum membayar iuran tidak boleh memberikan suara.",
    "Permintaan salinan dapat ditolak jika alasan pemohon tidak sah.",
    "Kantor tidak menanggapi surat tanpa tanda tangan.",
    "Izin gudang tidak dapat dialihkan kepada pihak lain.",
    "Tidak, hal itu dilarang menurut Pasal 3.",
    "Sistem pendaftaran tidak menerima berkas setelah pukul empat.",
    "Pemohon dapat menghubungi penasihat hukum sebelum sidang dimulai.",
    "Notaris menolak membuat akta bila salah satu pihak tidak hadir.",
    "Ketentuan ini belum berlaku bagi gudang yang dibangun sebelum tahun 2010.",
    "Layanan dihentikan apabila tarif tidak dibayar.",
    "Direksi tidak bisa mewakili perusahaan dalam perkara tersebut.",
)


def test_phrasings_not_taught():
    refused = [d == "refusal" for d, _ in TAGGER().defects([(ASKED, c) for c in REFUSED])]
    sound = [d is None for d, _ in TAGGER().defects([(ASKED, c) for c in SOUND])]
    recall, right = sum(refused) / len(REFUSED), sum(refused) / (sum(refused) + len(SOUND) - sum(sound))
    assert recall >= 0.9 and right >= 0.9, ([c for ok, c in zip(refused, REFUSED) if not ok], [c for ok, c in zip(sound, SOUND) if not ok])
    # the answers to earlier complaints
    assert sound[:4] == [True] * 4


def test_any_length():
    """Long responses are tagged like short ones, and are learned from."""
    items = [f"Pemilik gudang wajib mencatat kartu anggota nomor {i} kepada Badan Taruna selama {i % 9 + 2} bulan." for i in range(40)]
    cases = [" ".join(items), " ".join(items) + " Pemilik gudang wajib mencatat kartu anggota setelah lewat", " ".join(["Maaf, saya tidak bisa membantu soal gudang."] * 40)]
    assert [d for d, _ in TAGGER().defects([(ASKED, c) for c in cases])] == [None, "truncated", "refusal"]
    rows = [(f"r{i}", "Bagaimana aturan gudang?", " ".join(items)) for i in range(30)]
    made = broken_pairs.training_pairs(rows, broken_pairs.Ends())
    extract = broken_pairs.Extractor(broken_pairs.Ends())
    assert max(len(extract.pair(p, c)[0]) for p, c, *_ in made) >= 40
    assert broken_pairs.PairTagger.fit(rows).defects([rows[0][1:]])[0][0] is None


def test_short_prompts_and_other_scripts():
    cases = [("Izin usaha?", "izin usaha", "copy"), ("Izin usaha?", "Izin usaha. Izin usaha.", "copy"), (ASKED, "Владелец склада обязан вести учёт карт участников в течение трёх месяцев.", "language"), (ASKED, "倉庫の所有者は三か月以内に記録しなければならない。", "language")]
    assert [d for d, _ in TAGGER().defects([(p, c) for p, c, _ in cases])] == [d for *_, d in cases]


def test_empty_at_any_length():
    for text in (None, "", " \n", "N/A", "Jawaban:" + " " * 60 + "N/A", "n/a" + " ." * 500, "tidak ada jawaban\n" * 200, "Answer: -", "_" * 9000):
        assert is_empty(text), text
    for text in ("tidak ada jawabannya yang sah", "nasi", "tidak ada jawaban " * 200 + "selain itu", "kosong melompong", "Jawaban: 3", " " * 70 + "ya"):
        assert not is_empty(text), text


def test_hints_cover_what_asks_for_a_language():
    """Only prompts with a hint are searched: every phrase of the pattern has one."""
    for text in ("Terjemahkan ini", "alih bahasa", "Alihbahasakan", "translate", "vertaal", "Übersetze", "traduis", "traduce", "dalam bahasa Inggris", "ke bahasa Belanda", "in English", "into Indonesian", "in dutch", "in german", "into french", "auf Deutsch", "auf englisch", "en français", "en anglais", "en español", "in het Engels", "in het nederlands", "in het indonesisch"):
        assert broken_pairs._ASKS.search(text) and any(map(text.lower().__contains__, broken_pairs._ASK_HINTS)), text


def test_chain_field_against_enumeration():
    """Expected tags and the partition sum equal those over all sequences of tags."""
    import itertools

    import numpy as np

    from lontar.llm import crf

    rng = np.random.default_rng(4)
    moves, scores = rng.normal(size=(3, 3)), rng.normal(size=(2, 4, 3))
    mask = np.array([[True] * 4, [True, True, False, False]])
    near, want, total = crf._expected(scores[mask], mask, moves)
    at, whole, moved, by_row = 0, 0.0, np.zeros((3, 3)), []
    for x, n in zip(scores, (4, 2)):
        paths = list(itertools.product(range(3), repeat=n))
        weights = np.exp([sum(x[t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        whole += np.log(weights.sum())
        for t in range(n):
            by_row.append([weights[[p[t] == y for p in paths]].sum() / weights.sum() for y in range(3)])
        for p, w in zip(paths, weights / weights.sum()):
            for a, b in zip(p, p[1:]):
                moved[a, b] += w
    assert np.allclose(near, by_row) and np.allclose(want, moved) and np.isclose(total, whole)
    field = crf.ChainCRF(rng.normal(size=(5, 3)), moves)
    sequence = [[0, 2], [1], [3, 4], [2]]
    best = max(itertools.product(range(3), repeat=4), key=lambda p: sum(field.weights[on, y].sum() for on, y in zip(sequence, p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
    assert field.decode([sequence]) == [list(best)]


def test_defects_edges(spark):
    schema = "id string, prompt string, completion string, defect string, answer double"
    assert rows_of(broken_pairs.defects(spark.createDataFrame([], schema))) == []
    df = spark.createDataFrame([("a", None, "Pasal 3 berlaku.", "", 0.0), ("b", None, None, "", 0.0), ("b", None, None, "", 0.0), ("c", "p", "kata " * 50_000 + ".", "", 0.0)], schema)
    assert [r for r in rows_of(broken_pairs.defects(df)) if r[1] == "empty"] == [("b", "empty"), ("b", "empty")]


def test_counts_equal_the_pairs(spark):
    qa = table(spark, "/root/testdata/sf0.01", "qa_sft")
    splits = {r.id: r.split for r in qa.select("id", "split").collect()}
    wanted = {}
    for a, b in rows_of(overlaps.overlaps(qa)):
        e = b if splits[a] == "train" else a
        wanted[e] = wanted.get(e, 0) + 1
    assert {r.id: r.links for r in overlaps.overlap_counts(qa).collect()} == wanted


def test_long_rows_are_learned_from(spark):
    """A table of which every row has more than 20 000 characters."""
    rows = [(f"r{i:03}", f"Bagaimana aturan gudang nomor {i}?", " ".join(f"Pemilik gudang wajib mencatat kartu anggota nomor {i + k} kepada Badan Taruna selama {k % 9 + 2} bulan." for k in range(230))) for i in range(24)]
    rows.append(("zz", "Bagaimana aturan gudang?", " ".join(["Maaf, saya tidak bisa membantu soal gudang."] * 500)))
    assert min(len(c) for *_, c in rows) > 20_000
    df = spark.createDataFrame(rows, "id string, prompt string, completion string")
    assert rows_of(broken_pairs.defects(df)) == [("zz", "refusal")]


def test_all_rows_are_counted(spark):
    """Ends and words are those of all rows, of which there are more than go into a block."""
    qa = table(spark, "/root/testdata/sf0.01", "qa_sft").select("id", "prompt", "completion")
    rows = [tuple(r) for r in qa.collect()]
    assert len(rows) > broken_pairs.BLOCK_ROWS
    ends, used = broken_pairs.Ends(), {}
    for *_, c in rows:
        if not is_empty(c):
            ends.learn(c)
            for w in set(broken_pairs._WORD.findall(c.lower())):
                used[w] = used.get(w, 0) + 1
    got = broken_pairs.fitted(qa.repartition(5)).extract.ends
    for tail in ends.ending.keys() | ends.going.keys():
        if (n := ends.ending[tail] + ends.going[tail]) >= (3 if len(tail) > 1 else 1):
            assert (got.ending[tail], got.going[tail]) == (ends.ending[tail], ends.going[tail]), (tail, n)
    assert got.known == {w for w, n in used.items() if n >= 2}
    assert got.usual == {w for w, n in used.items() if n >= broken_pairs.USUAL * len(rows)}


def test_fit_of_blocks(spark):
    """Neither order, partitions nor repeated rows matter; one block is fitted like a list of rows."""
    import numpy as np

    qa = table(spark, SMALL, "qa_sft").select("id", "prompt", "completion").where("id is not null").distinct()
    one, other = broken_pairs.fitted(qa.coalesce(1), 150), broken_pairs.fitted(qa.union(qa).orderBy(qa.prompt.desc()).repartition(7), 150)
    assert one.words == other.words and (one.crf.weights == other.crf.weights).all() and (one.crf.moves == other.crf.moves).all()
    whole, listed = broken_pairs.fitted(qa), broken_pairs.PairTagger.fit(sorted((tuple(r) for r in qa.collect()), key=lambda r: r[0]))
    assert whole.words == listed.words and np.allclose(whole.crf.weights, listed.crf.weights, atol=1e-3)
    # a word that stands once in every block is learned too
    assert len(one.words) > 0.9 * len(whole.words)


def test_clauses_are_read_once(monkeypatch):
    """The responses made of a row share clauses, which are read once and give what a fresh reader gives."""
    rows = [tuple(r) for r in pd.read_parquet(f"{SMALL}/qa_sft.parquet", columns=["id", "prompt", "completion"]).dropna().sort_values("id").itertuples(index=False)]
    ends, times = broken_pairs.Ends(), []
    made = [(p, c) for p, c, *_ in broken_pairs.training_pairs(rows, ends)]
    fresh = [broken_pairs.Extractor(ends).pair(p, c) for p, c in made]
    foreign = broken_pairs.Extractor._foreign
    monkeypatch.setattr(broken_pairs.Extractor, "_foreign", lambda *a: times.append(a[1]) or foreign(*a))
    one = broken_pairs.Extractor(ends)
    for (shapes, texts, *sizes), (p, c) in zip(fresh, made):
        got_shapes, got_texts, *got_sizes = one.pair(p, c)
        assert (got_shapes, list(map(sorted, got_texts)), got_sizes) == (shapes, list(map(sorted, texts)), sizes)
    whole = [(p, part) for p, c in made for part in broken_pairs.clauses(c)]
    assert len(times) <= len({(p, part.rstrip(" .!?;:,")) for p, part in whole}) < 0.8 * len(whole)
    # one prompt for all rows keeps no more
    assert len(one.pair(ASKED, " ".join(f"Kartu nomor {i} berlaku." for i in range(5000)))[0]) == 5000
    assert len(one.read) <= broken_pairs.KEPT


def test_counts_and_refusals_of_blocks():
    """Several blocks are counted like each by itself; no refusal is passed over before its words are weighed."""
    rows = [tuple(r) for r in pd.read_parquet(f"{SMALL}/qa_sft.parquet", columns=["id", "prompt", "completion"]).dropna().sort_values("id").itertuples(index=False)]
    rows += [(f"zz{i}", ASKED, c) for i, c in enumerate((*REFUSED, *SOUND, "MAAF, SAYA TIDAK BISA MEMBANTU.", ASKED, '"'))]
    blocks, summed = [rows[::2], rows[1::2]], {}
    for block in blocks:
        for kind, key, numbers in broken_pairs.counts([block]):
            summed[kind, key] = [a + b for a, b in zip(summed.get((kind, key), (0, 0)), numbers)]
    facts = list(broken_pairs.counts(blocks))
    assert len(facts) == len(summed) and {(k, w): n for k, w, n in facts} == summed
    learned = broken_pairs.Learned.of(facts, len(rows))
    for _ in range(2):
        found, extract = 0, broken_pairs.Extractor(learned.ends)
        for row in rows:
            words = set() if is_empty(row[2]) else extract.single(row[1], broken_pairs.clauses(row[2]))
            prior = math.log(broken_pairs.DECLINED / (1 - broken_pairs.DECLINED))
            sounds = any(prior + sum(known.get(w, unseen) for w in sorted(words)) > 0 for known, unseen in learned.rounds)
            assert broken_pairs.declined(extract, row, learned) == (words if sounds else set())
            found += sounds
        assert 0 < found < len(rows)
        learned.weigh(list(broken_pairs.found_words(blocks, learned)))
