"""Problems 6, 7 and 8."""

import random

import pyarrow as pa
import pytest

from seamline.llm import p6_encoding_ids as p6
from seamline.llm import p7_packing as p7
from seamline.llm import p8_encoding as p8

DOC = "doc_id bigint, text string, ids string, n_tokens string"


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{p6.TOKENIZERS_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


HARD = ["", " ", "Hello, it's 42!", "中文和 code_name()", "<|endoftext|>", "a\n\n  b\t\r\n ", "👩‍💻 é\u0301 ñ", "x" * 5000, "ab" * 3000, "-" * 2000, "\u3000\xa0 \u200b", "don't WE'LL 'S", "é" * 300, "\x00\x01", "ſ İ ß 🎉🎉"]


def test_merge_is_exact():
    import base64  # noqa: F401

    rank = p6.ranks("byte_bpe_50k")
    for text, want in zip(HARD, reference(HARD)):
        assert [i for w in p6._WORDS.findall(text) for i in p6.merge(w.encode(), rank)] == want


def test_transducer_numbers_every_word_once():
    rng = random.Random(8)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 7))) for _ in range(400)}, key=lambda w: rng.random())
    lex = p6.compile_lexicon(words, [[k, len(w)] for k, w in enumerate(words)])
    number = p6.look_up(lex, words)
    assert sorted(number) == list(range(len(words)))
    for w, n in zip(words, number):
        assert list(lex["ids"][lex["offset"][n] : lex["offset"][n + 1]]) == [words.index(w), len(w)]
    others = [b"d", b"abcabcabc", b"a" * 60, b""]
    assert [n for n, w in zip(p6.look_up(lex, others), others) if w not in words] == [-1] * sum(w not in words for w in others)
    assert len(lex["final"]) < sum(map(len, words)) and list(p6.look_up(p6.compile_lexicon([], []), [b"a"])) == [-1]


def test_ids_operator(spark):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(HARD * 2)] + [(99, None, "", "")]
    got = {r["doc_id"]: r["ids"] for r in p6.token_ids(spark.createDataFrame(rows, DOC)).collect()}
    want = reference(HARD * 2)
    assert len(got) == len(rows) and got[99] == [] and all(got[k] == w for k, w in enumerate(want))
    assert p6.token_ids(spark.createDataFrame([], DOC)).count() == 0


def test_lexicon_counts_every_document(spark):
    """Every word stands in two documents of 44,000; what is counted on some of them misses words or counts them once."""
    spell = "translate(cast(id div 2 as string), '0123456789', 'abcdefghij')"
    docs = spark.range(44_000).selectExpr("id as doc_id", f"{spell} as text").unionAll(spark.sql("select -1L, 'often often often'"))
    words = p6.frequent_words(docs)
    assert words[0] == " often" and set(words[1:]) == {"".join("abcdefghij"[int(c)] for c in str(k)) for k in range(22_000)} and len(words) == 22_001
    assert {(r["word"], r["n"]) for r in p6.word_counts(docs).where("word like '%often'").collect()} == {("often", 1), (" often", 2)}


def test_split_equals_the_pattern(monkeypatch):
    rng = random.Random(5)
    some = [*"strevmldSTaé中1٣½ \n\t\r\x85\xa0\u3000\x1c\x1f\u200b!-_.\x00🎉𝒳𐍈\u0301\u0163\u0165\u0172", "'", "'s", "'re", "'ll", "'ve", "'d", "  "]
    batches = [[], [None], ["", None], ["'", "s"], ["'r", "e"], ["a ", " b"], HARD]
    batches += [[None if rng.random() < 0.1 else "".join(rng.choices(some, k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(20)] for _ in range(400)]
    batches += [["".join(chr(c) for c in rng.choices([*range(0xD800), *range(0xE000, 0x110000)], k=200)) for _ in range(5)] for _ in range(40)]
    for size in (1, 100, p6.SPLIT_BYTES):
        monkeypatch.setattr(p6, "SPLIT_BYTES", size)
        for texts in batches:
            counts, words = p6.split(pa.array([None, *texts, "x"], pa.string()).slice(1, len(texts)))
            want = [p6._WORDS.findall(t or "") for t in texts]
            assert list(counts) == list(map(len, want)) and words.to_pylist() == [w for row in want for w in row]


@pytest.mark.parametrize("capacity", [1, 7, 64, 512])
def test_plans_hold_every_item_once(capacity):
    rng = random.Random(capacity)
    counts = {s: rng.randint(1, 30) for s in rng.sample(range(1, capacity + 1), min(capacity, 25))}
    patterns = p7.plan(counts, capacity)
    packed: dict[int, int] = {}
    for times, sizes in patterns:
        assert times > 0 and sum(sizes) <= capacity
        for s in sizes:
            packed[s] = packed.get(s, 0) + times
    assert packed == counts
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    first_fit = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        for k, room in enumerate(first_fit):
            if room >= s:
                first_fit[k] -= s
                break
        else:
            first_fit.append(capacity - s)
    assert least <= sum(t for t, _ in patterns) <= len(first_fit)


def test_exact_complements_are_used():
    assert p7.plan({6: 1, 3: 1, 1: 1, 5: 2, 4: 1}, 10) and sum(t for t, _ in p7.plan({7: 2, 2: 2, 1: 2}, 10)) == 2 and p7.plan({}, 10) == []


def test_packing_operator(spark):
    rng = random.Random(3)
    texts = [" word" * rng.choice([0, 1, 3, 8, 8, 8, 20, 45]) for _ in range(200)] + [None, "", " word" * 130] + [" word" * 8] * 60
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], DOC)
    caps = spark.createDataFrame([("small", "byte_bpe_50k", 40), ("large", "byte_bpe_50k", 128), ("none", "byte_bpe_50k", 0), ("null", None, 5)], "capacity_name string, tokenizer_name string, capacity_tokens int")
    rows = p7.packing(docs, caps).collect()
    for name, capacity in (("small", 40), ("large", 128)):
        mine = [r for r in rows if r["capacity_name"] == name]
        fill: dict[int, int] = {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert max(fill.values()) <= capacity
        for k, t in enumerate(texts):
            n = len(t or "") // 5
            parts = sorted((r["piece_no"], r["start_token"], r["n_tokens"]) for r in mine if r["doc_id"] == k)
            assert sum(p[2] for p in parts) == n and (len(parts) == 1 if n <= capacity else len(parts) == -(-n // capacity)) and [p[0] for p in parts] == list(range(len(parts)))
    w = {r["capacity_name"]: r for r in p7.waste(p7.packing(docs, caps)).collect()}
    assert w["small"]["containers"] <= w["small"]["fewest"] + 8
    assert {r["container_id"] for r in p7.packing(docs.where("text is null or text = ''"), caps).collect()} == {0}
    assert p7.packing(docs.limit(0), caps).count() == 0


def test_numbering_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(p7, "BUCKET_ROWS", 7)
    items = spark.createDataFrame([(k, 0, 0, 5 if k % 3 else 2) for k in range(60)], "doc_id bigint, piece_no int, start_token bigint, n_tokens bigint")
    got = p7._numbered(items, 9).collect()
    for size in (5, 2):
        assert sorted(r["rank"] for r in got if r["n_tokens"] == size) == list(range(sum(r["n_tokens"] == size for r in got)))


ZH = "请先打开配置文件，因为风险说明依赖这个文件。另外，动作列表现在会从这里读取默认值。"
FR = "Il reste à décider si « moyenne générale » doit être triée, puisqu’elle n’est pas prête — voilà."
GARBLES = [(t.encode(right).decode(wrong), t) for t, right, wrong in [(ZH, "utf-8", "latin-1"), (ZH, "gbk", "latin-1"), (FR, "utf-8", "latin-1"), (FR, "utf-8", "cp437"), (FR, "utf-8", "mac_roman"), (ZH, "utf-8", "mac_roman"), (ZH, "utf-8", "cp437")]]
GARBLES.append((FR.encode().decode("latin-1").encode().decode("latin-1"), FR))


@pytest.mark.parametrize(("garbled", "meant"), GARBLES)
def test_restores(garbled, meant):
    for text, want in ((garbled, meant), (f"# Title\n{garbled}\ncode = 1", f"# Title\n{meant}\ncode = 1")):
        fixed, changed, lost, *_ = p8.repair(text)
        assert fixed == want and changed and not lost


INNOCENT = ["", None, "plain", FR, ZH, "ATENÇÃO: a SEÇÃO NÃO será mantida após a MIGRAÇÃO. SÃO, MAÇÃ, ÂMBITO", "naïve café ™ © ® ¶ ½ ± 20 °C № 5 €30", "шалом שלום مرحبا", "１２３ＡＢＣ 🎉 👩‍💻", "When the log shows `Ã©` for a letter, check it.", "如果日志里出现“锟斤拷”这样的字符，请检查。", 'if ch == "�":', "a/\n├── b\n│   └── c", "Übrig bleibt „Änderung“ – gut…"]


@pytest.mark.parametrize("text", INNOCENT)
def test_innocent(text):
    assert p8.repair(text) is None


@pytest.mark.parametrize("text", ["Il reste � d�cider", "锟斤拷锟斤拷 open 锟斤拷", FR.encode("latin-1", "ignore").decode("utf-8", "replace")])
def test_lost_is_reported(text):
    assert p8.repair(text)[2]


def test_encoding_operator(spark):
    rows = [(1, GARBLES[0][0], "", ""), (2, GARBLES[0][0], "", ""), (3, ZH, "", ""), (4, None, "", ""), (5, "", "", ""), (6, (FR + " ") * 400 + GARBLES[2][0], "", "")]
    df = spark.createDataFrame(rows, DOC)
    assert sorted(r[0] for r in p8.found(df).collect()) == [1, 2, 6] and p8.repaired(df).where("doc_id = 6").first()["repaired"].endswith(FR) and p8.found(df.limit(0)).count() == 0
