"""The llm operators at their bounds: inputs just over former limits, shapes that need every round, memory of large tables."""

from __future__ import annotations

import itertools
import random
import resource
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("millrace.llm")

from millrace.llm import credentials as C
from millrace.llm import leakage, neardup, packing, provenance, quality, splitting, vectors

# --- provenance


def declared_projects(n=6):
    rows, i = [], 0
    for p in range(n):
        rows.append((i := i + 1, f"p{p}", ".gitattributes", "wire/** linguist-generated\ncopied/** linguist-vendored\n*_stub.py linguist-generated=true\nhand/** -linguist-generated -linguist-vendored\n"))
        for k in range(4):
            rows.append((i := i + 1, f"p{p}", f"wire/m{p}{k}.py", f"# Emitted for service {k} of the wire compiler\nx = {k}\n"))
            rows.append((i := i + 1, f"p{p}", f"copied/lib{k}.py", "def f():\n    return 1\n"))
            rows.append((i := i + 1, f"p{p}", f"api/s{k}_stub.py", "y = 2\n"))
            rows.append((i := i + 1, f"p{p}", f"app/real{k}.py", f"# Written for people {k}\ndef g():\n    return {k}\n"))
            rows.append((i := i + 1, f"p{p}", f"hand/own{k}.py", "# Emitted for nobody at all here\nz = 1\n"))
    return rows


def test_signs_are_mined_from_declared_projects_and_found_elsewhere(spark):
    held_out = [(900, "new", "src/wire/a.py", "q = 1\n"), (901, "new", "deep/copied/b.py", "q = 1\n"), (902, "new", "x/t_stub.py", "q = 1\n"), (903, "new", "lib/c.py", "# Emitted for service 77 of the wire compiler\nq = 1\n"), (904, "new", "app/own.py", "# Written for people 5\nq = 1\n"), (905, None, "x/u_stub.py", None)]
    df = spark.createDataFrame(declared_projects() + held_out, "id long, p string, path string, t string")
    got = {r.id: (r.kind, r.reason) for r in provenance.not_handwritten(df, "id", "p", "path", "t").collect() if r.id >= 900}
    assert got == {900: ("generated", "mined"), 901: ("vendored", "mined"), 902: ("generated", "mined"), 903: ("generated", "mined"), 905: ("generated", "mined")}
    alone = spark.createDataFrame(held_out, "id long, p string, path string, t string")
    assert provenance.not_handwritten(alone, "id", "p", "path", "t").count() == 0


def test_mined_signs_count_beyond_the_number_sent_to_tasks(spark):
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 100_010)]
    long = f"# {' '.join(words)}\nx = 1\n"
    rows = [(1, "p", ".gitattributes", "wire/** linguist-generated\n"), (2, "q", ".gitattributes", "wire/** linguist-generated\n"), (3, "p", "wire/a.py", long), (4, "p", "wire/b.py", long), (5, "q", "wire/c.py", long), (6, "p", "app/d.py", "y = 1\n")]
    rows += [(7, "new", "lib/first.py", f"# {' '.join(words[:4])}\ny = 1\n"), (8, "new", "lib/last.py", f"# {' '.join(words[-4:])}\ny = 1\n"), (9, "new", "lib/none.py", f"# {' '.join(words[3::-1])}\ny = 1\n")]
    df = spark.createDataFrame(rows, "id long, p string, path string, t string")
    got = sorted((r.id, r.kind, r.reason) for r in provenance.not_handwritten(df, "id", "p", "path", "t").collect())
    assert got == [*((i, "declared", "attributes") for i in (3, 4, 5)), (7, "generated", "mined"), (8, "generated", "mined")]


@pytest.mark.parametrize("most_signs", [0, 1, 100_000])
def test_mined_signs_give_the_same_rows_sent_or_joined(spark, most_signs):
    rows = declared_projects()
    for p in range(6):  # files that bear both marks
        rows.append((700 + p, f"p{p}", "both/.gitattributes", "*.py linguist-generated linguist-vendored\n"))
        rows += [(710 + 4 * p + k, f"p{p}", f"both/m{p}{k}.py", "x = 1\n") for k in range(4)]
    denies = [(800, "denies", ".gitattributes", "both/** -linguist-generated\nnone/** -linguist-generated -linguist-vendored\n"), (906, "denies", "both/a.py", "q = 1\n"), (907, "denies", "none/t_stub.py", "q = 1\n")]
    held_out = [(900, "new", "src/wire/a.py", "q = 1\n"), (901, "new", "deep/copied/b.py", "q = 1\n"), (901, "new", "deep/copied/b.py", "q = 1\n"), (902, "new", "copied/t_stub.py", None), (903, None, "both/b.py", "q = 1\n"), (904, "new", "app/own.py", "q = 1\n"), (901, "new", "app/own.py", "q = 1\n"), (905, "new", "vendor/wire/a.py", "q = 1\n"), (908, "new", None, "q = 1\n"), (None, "new", "src/wire/a.py", "q = 1\n")]
    df = spark.createDataFrame(rows + denies + held_out, "id long, p string, path string, t string")
    got = sorted((r.id, r.kind, r.reason) for r in provenance.not_handwritten(df, "id", "p", "path", "t", most_signs=most_signs).collect() if r.id >= 900)
    assert got == [(900, "generated", "mined"), (901, "vendored", "mined"), (901, "vendored", "mined"), (902, "generated", "mined"), (903, "generated", "mined"), (905, "vendored", "directory"), (906, "vendored", "mined")]


def test_marks_are_taken_back_or_denied_one_by_one(spark):
    attributes = "vendor/** linguist-vendored\nvendor/a.py !linguist-vendored\n*_pb2.py linguist-vendored=false\nnode_modules/** linguist-vendored=false linguist-generated=false\n"
    rows = [(1, "p", ".gitattributes", attributes), (2, "p", "vendor/a.py", "x"), (3, "p", "vendor/b.py", "x"), (4, "p", "a_pb2.py", "x"), (5, "p", "node_modules/c.js", "x"), (6, "p", "lib/vendor/a.py", "x")]
    df = spark.createDataFrame(rows, "id long, p string, path string, t string")
    got = {r.id: (r.kind, r.reason) for r in provenance.not_handwritten(df, "id", "p", "path", "t").collect()}
    # Taken back: judged by convention. Only vendored is denied: the name still says generated.
    assert got == {2: ("vendored", "directory"), 3: ("declared", "attributes"), 4: ("generated", "name"), 6: ("vendored", "directory")}


@pytest.mark.parametrize("path,text,kind", [("src/app/deps/auth.py", "def f():\n    pass\n", None), ("deps/lib/a.py", "def f():\n    pass\n", "vendored"), ("a.py", "# Copyright (c) 2024 the Foo authors\nx = 1\n", None), ("a.py", '"""Finds files which say do not edit."""\nx = 1\n', None), ("a.py", "# note\n" * 40 + "# Do not edit.\nx = 1\n", "generated"), ("a.py", "# " + "x" * 300 + "\n# Code generated by t. DO NOT EDIT.\n", "generated")])
def test_weak_signs_alone_are_none(path, text, kind):
    got = provenance.judge(path, text)
    assert (got and got[0]) == kind


# --- credentials


@pytest.mark.parametrize("line,found", [('password = "xK9 qPz7 mWv2 Lr4"', True), ('PASSPHRASE = "correcthorsebatterystaple"', True), ('password = "enter your password here 1"', False), ('token = "checkpoint"', False), ('title = "xK9 qPz7 mWv2 Lr4"', False)])
def test_passphrases(line, found):
    assert bool(C.find_credentials(line + "\n", C.dictionary(C.DICTIONARY), True)) == found


def test_names_far_before_their_value():
    value = "aB3dE5gH7jK9mN1pQ4"
    assert C.find_credentials(f'x = {{"{"very_" * 60}password": "{value}"}}\n', C.dictionary(C.DICTIONARY), True)


# --- packing


@pytest.mark.parametrize("leaves,rows_per_task", [(4, 20_000), (16, 100)])
def test_packing_depends_on_items_alone(spark, leaves, rows_per_task):
    rng = random.Random(9)
    sizes = [(i % 300, rng.choice([1000, 300, 700, 1, 999, 2000, 640])) for i in range(1200)]
    out = []
    for rows, parts in ((sizes, 3), (sizes[::-1], 7)):
        df = spark.createDataFrame(rows, "id long, tokens long").repartition(parts)
        out.append(Counter(tuple(r) for r in packing.pack(df, 1000, leaves=leaves, rows_per_task=rows_per_task).collect()))
    assert out[0] == out[1]
    fill = Counter()
    for (container, _, _, _, tokens), n in out[0].items():
        fill[container] += tokens * n
    assert max(fill.values()) <= 1000 and sum(out[0].values()) == len(sizes) + sum(n == 2000 for _, n in sizes)


def test_equal_rows_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(5, 3000)] * 7 + [(6, 4096)] * 3, "id long, tokens long")
    assert packing.pack(df).select("container").distinct().count() == 10


def test_bins_that_cannot_merge_end_the_tree(spark):
    df = spark.range(400).select("id", F.lit(600).alias("tokens"))
    assert packing.pack(df, 1000, rows_per_task=50).select("container").distinct().count() == 400


# --- splitting


def test_ranges_of_a_giant_text_are_linear(spark):
    def seconds(n):
        df = spark.range(1).select("id", F.repeat(F.lit("Ein Satz. Noch einer.\n"), n).alias("t"))
        began = time.perf_counter()
        got = splitting.text_ranges(df, "id", "t", 4000, 50_000).agg(F.count("*"), F.sum(F.length("body"))).first()
        assert got[1] == 22 * n and got[0] == -(-22 * n // 50_000)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(1_000_000) < 40 * max(0.5, seconds(100_000))


def test_ranges_are_read_by_uri(tmp_path):
    (tmp_path / "a b.txt").write_bytes(b"0123456789")
    assert splitting.read_range(str(tmp_path / "a b.txt"), 3, 4) == b"3456"
    (tmp_path / "c.txt").write_bytes(b"0123456789")
    assert splitting.read_range(f"file://{tmp_path}/c.txt", 8, 4) == b"89" and splitting.read_range(f"file://{tmp_path}/c.txt", 80, 4) == b""


# --- leakage


def test_many_items_stay_in_memory():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30_000)]
    common = ["the", "of", "and", "a", "to"]
    items = [(i, [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(35)]) for i in range(20_000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = leakage.ItemIndex(items, 15, 4)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    # 20,000 items; in proportion 100,000 need five times as much.
    assert grown < 600
    held = sum(x.nbytes for x in vars(index).values() if hasattr(x, "nbytes"))
    assert held < 100e6
    import numpy as np

    get = index.vocab.get
    words = [get(w, -1) for w in [*["x"] * 20, *items[777][1][5:21], *["y"] * 20, *items[4][1]]]
    flat = np.array(words, dtype=np.int32)
    found = {i for d, lo, hi in index.retrieve(flat, np.array([0])) for i in index.matches(flat[lo:hi])}
    assert found == {777, 4}


# --- quality

PROSE = {
    "fr": "Le moteur lit chaque fichier une seule fois et garde le résultat dans la mémoire. Il ne demande jamais plus que ce dont il a besoin, et le journal dit pourquoi.",
    "es": "El motor lee cada archivo una sola vez y guarda el resultado en la memoria. No pide nunca más de lo que necesita, y el registro dice por qué.",
    "ru": "Двигатель читает каждый файл один раз и хранит результат в памяти. Он никогда не просит больше, чем ему нужно, и журнал говорит, почему это так.",
    "ja": "エンジンは各ファイルを一度だけ読み、結果をメモリに保存します。必要以上のものを要求することはなく、ログにその理由が書かれています。",
    "el": "Η μηχανή διαβάζει κάθε αρχείο μία φορά και κρατά το αποτέλεσμα στη μνήμη. Δεν ζητά ποτέ περισσότερα από όσα χρειάζεται, και το ημερολόγιο λέει γιατί.",
    "ko": "엔진은 각 파일을 한 번만 읽고 결과를 메모리에 보관합니다. 필요한 것보다 더 많이 요구하지 않으며, 로그에 그 이유가 적혀 있습니다.",
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_prose_of_other_languages_runs(lang):
    a, b = quality.running_parts(PROSE[lang])
    assert a == b > 0


@pytest.mark.parametrize("text", ["Café\nZoë\nNaïve\nÉlan\n" * 9, "тип; размер; имя\n1; 2; 3\n" * 9, "名前: 値\n" * 9, "данные | число | итог\n" * 9])
def test_lists_of_other_languages_do_not(text):
    a, b = quality.running_parts(text)
    assert a < 0.5 * b


def test_the_score_decides_near_the_bar(spark):
    names = ["running_share", "junk_lean"]
    rows = [("en", 0.9, -1.0), ("en", 0.95, -1.2), ("en", 0.1, 2.0), ("en", 0.0, 2.2), ("en", 0.45, -0.9), ("en", 0.55, 1.9), ("xx", 0.45, -9.0), ("xx", 0.55, 9.0), (None, 0.1, 0.0)]
    df = spark.createDataFrame([(i, r[0] or "und", *r[1:]) for i, r in enumerate(rows)], f"id int, lang string, {names[0]} double, {names[1]} double")
    assert {r.id for r in quality.unnatural(df).collect()} == {2, 3, 5, 6, 8}


# --- vectors and near duplicates


def test_pivots_grow_with_the_root():
    assert vectors.pivots_for(10, 15) == vectors.LEAST_PIVOTS
    assert vectors.pivots_for(4_000_000, 15) > 5 * vectors.pivots_for(100_000, 15)
    assert vectors.pivots_for(10**12, 15) == vectors.MOST_PIVOTS


@pytest.mark.parametrize("rare", [0, 3, 10**9])
def test_prefix_index_is_lossless_whatever_counts_as_rare(spark, rare):
    rng = random.Random(11)
    vocab = [f"t{i}" for i in range(40)]
    texts = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 30]))] for _ in range(150)]
    for k in range(60):
        t = list(texts[k])
        t[rng.randrange(len(t))] = rng.choice(vocab)
        rng.shuffle(t)
        texts.append(t)
    df = spark.createDataFrame([(f"m{i:03}", " ".join(t)) for i, t in enumerate(texts)], "id string, t string")
    words = neardup.content_words(df, "id", "t")
    links, members = neardup.near_duplicate_classes(words, 0.8, tolerance=0.0, rare=rare, short=20)
    by = {r.id: r.cid for r in members.collect()}
    got = {(r.a, r.b) for r in links.collect()}
    want = set()
    for i, x in enumerate(texts):
        for j in range(i):
            y = texts[j]
            a, b = sorted((by[f"m{i:03}"], by[f"m{j:03}"]))
            if a != b and sum((Counter(x) & Counter(y)).values()) >= 0.8 * max(len(x), len(y)) - 1e-9:
                want.add((a, b))
    assert got == want
