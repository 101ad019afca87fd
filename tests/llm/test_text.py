import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import abuse, byte_bpe, eval_leaks, scan_noise, speaker_turns
from gleanery.llm.token_queries import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
has_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file here")


# ---- encoding

def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@has_ranks
def test_ids_equal_the_public_encoder_and_decode_back(spark):
    enc = reference_encoding()
    rnd = random.Random(5)
    texts = [
        "", None, "Hello world", "  two  spaces \n\n\tand tabs ", "<|endoftext|> is text", "naïve café — 日本語 🙂🙂", "a" * 2000,
        "it's we'll THEY'RE 12345 x_y", " odd spaces　", "zqxjkv" * 30, "".join(chr(rnd.randint(32, 0x2FFF)) for _ in range(300)),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    ids = byte_bpe.encode_texts(df, RANKS)
    got = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    assert got == {i: (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode_ids(ids, RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@has_ranks
def test_long_word_merges_equal_the_public_encoder():
    enc, ranks = reference_encoding(), byte_bpe.read_ranks(RANKS)
    for w in ("abcab" * 80, "é" * 200, "thethethe" * 50):
        assert byte_bpe.merge_bytes(w.encode(), ranks) == enc.encode_ordinary(w)


@has_ranks
def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, [99999999])], "doc_id long, ids array<int>")
    assert byte_bpe.decode_ids(df, RANKS).collect()[0]["text"] is None


# ---- leaks

words = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_bit_parallel_distance_equals_dynamic_programming(p, t):
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        row = [i]
        for j, y in enumerate(t, 1):
            row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[-1] + 1))
        prev = row
    assert eval_leaks.myers(p, t) == min(prev)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(5, 50)))) for i in range(30)]
    docs = []
    for d in range(60):
        ws = rnd.choices(vocab, k=80)
        src = rnd.choice(items)[1].split()
        n = rnd.randint(8, 16)
        if len(src) > n:
            at = rnd.randrange(len(src) - n)
            ws[20:20] = src[at:at + n]
        docs.append((d, "  ".join(w.upper() for w in ws) + "!", "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "...", "x")]
    got = eval_leaks.leaks(
        spark.createDataFrame(docs, "doc_id long, text string, words string"),
        spark.createDataFrame(items + [items[0], (99, None)], "item_id long, text string"),
    ).where("distance = 0")
    shingles = lambda t: {tuple(t[i:i + 12]) for i in range(len(t) - 11)}
    want = {(d, i) for d, t, _ in docs if t for i, s in items if shingles(t.lower().replace("!", "").split()) & shingles(s.split())}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


# ---- turns

U = "doc_id long, speakers array<string>, version int, utterances array<struct<start_ms long, end_ms long, text string>>"


def test_turns(spark):
    cues = [(0, 1, "00:00:01 Ann Bell: um, hello"), (5, 6, "and more"), (3, 4, "[Music]"), (8, 9, "BELL, ANN: still me"), (10, 11, ">> hm."), (12, 13, ">> your turn"),
            (12, 13, ">> your turn"), (14, 15, "(Ann) Remember: this"), (16, 17, "Speaker 2: fine"), (18, 19, "Dr. Cole: yes"), (20, 21, None)]
    data = [(1, ["Ann Bell", "Bo Cole"], 1, cues), (2, None, 1, cues), (3, ["A B"], 1, None), (4, ["A B"], 1, [])]
    got = speaker_turns.speaker_turns(spark.createDataFrame(data + [data[0]], U)).orderBy("turn_no").collect()
    assert [(r["start_ms"], r["speaker"]) for r in got] == [(0, "Ann Bell"), (12, "Bo Cole"), (14, "Ann Bell"), (16, "Bo Cole")]
    assert got[0]["text"] == "hello and more still me" and got[2]["text"] == "Remember: this"


def test_unmarked_and_bare_marked_talks_start_with_the_first_billed(spark):
    data = [(1, ["A B", "C D"], 1, [(0, 1, ">> one"), (2, 3, ">> two")]), (2, ["A B"], 1, [(0, 1, "one"), (2, 3, ">> two")])]
    got = speaker_turns.speaker_turns(spark.createDataFrame(data, U)).orderBy("doc_id", "turn_no").collect()
    assert [(r["doc_id"], r["start_ms"], r["speaker"]) for r in got] == [(1, 0, "A B"), (1, 2, "C D"), (2, 0, "A B")]


def test_cue_order_drops_conflicting_delivery():
    assert speaker_turns.cue_order([(5, 6, "b"), (1, 2, "a"), (5, 6, "b"), (5, 6, "c")]) == [1, 0, 3]
    # together at 5: delivered a b c, ended b c a; the weaker edges of the cycle go
    cues = [(5, 9, "a"), (5, 6, "b"), (5, 7, "c"), (1, 2, "x")]
    assert speaker_turns.cue_order(cues, "auto") == [3, 1, 2, 0]
    assert speaker_turns.cue_order(cues, " Human ") == [3, 0, 1, 2]


def test_labels_in_front_of_words_that_look_like_labels():
    names = speaker_turns.name_index(["Imka Gorebemire", "Emrys Jorebelok"])
    assert speaker_turns.split_cue("(00:00:40) GOREBEMIRE - My point: it costs", names, 2, 1) == (0, False, "My point: it costs")
    assert speaker_turns.split_cue("Remember: - it costs", names, 2, 1) == (None, False, "Remember: - it costs")
    assert speaker_turns.split_cue(">> Emrys: <i>sighs</i>", names, 2, 1) == (1, True, "")
    assert speaker_turns.split_cue("It is <i>very</i> odd", names, 2, 1) == (None, False, "It is very odd")


# ---- scanned pages

def test_line_kinds_of_a_book():
    body = ["A long line of running text that fills the page wid-", "th and goes on in the second line, as it should do.", "It ends here."]
    pages = {
        1: ["The small garden", "Ann Bell", "Printed 2001"],
        2: ["Chapter 1", "How plants grow in spring", *body, "2"],
        3: ["HOW PLANTS GROW IN SPRING", *body, "#21 64>~6 $=\\< >@6^", "[3]"],
        4: ["The small garden   4", *body],
        5: [], 6: None,
    }
    book = scan_noise.Book(pages, {3: "3", 4: None}, None)
    kinds = {(r[0], r[1]): r[2] for r in book.lines()}
    assert [kinds[1, i] for i in (1, 2, 3)] == ["heading"] * 3
    assert kinds[2, 2] == "heading" and kinds[2, 6] == "furniture"
    assert kinds[3, 1] == "furniture" and kinds[3, 5] == "garbled" and kinds[3, 6] == "furniture"
    assert kinds[4, 1] == "furniture" and kinds[4, 2] == "body"
    assert scan_noise.Book({}, {}, "not json").lines() == []


def test_confusions_and_decoding():
    flat = {c: 1.0 for c in scan_noise.CONFUSIONS}
    assert scan_noise.align("the", "fhe", flat)[0] == 1 and scan_noise.align("modern", "rnoclern", flat)[0] == 2
    assert scan_noise.align("the", "she", flat) is None
    doubts = [{"pos": 1, "n_read": 1, "cands": [{"cand": "the", "uses": scan_noise.align("the", "fhe", flat)[1], "n_cand": 50}]}]
    costs = [-7.8] * len(flat)
    assert scan_noise.viterbi(["in", "fhe", "end"], doubts, {("in", "the"): (20, 40)}, 1000.0, costs) == ["in", "the", "end"]
    rare = [{"pos": 0, "n_read": 30, "cands": [{"cand": "the", "uses": [1], "n_cand": 150}]}]
    assert scan_noise.viterbi(["fhe"], rare, {}, 1000.0, costs) == ["fhe"]


def test_every_confusion_keeps_the_skeleton(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    rows = []
    for _ in range(300):
        true = "".join(rnd.choice("etolishgbzandumwrcfp0159") for _ in range(rnd.randint(1, 12)))
        read, at = "", 0
        while at < len(true):  # several confusions in one word
            fits = [(t, r) for t, r in scan_noise.CONFUSIONS if true.startswith(t, at)]
            if fits and rnd.random() < 0.5:
                t, r = rnd.choice(fits)
                read, at = read + r, at + len(t)
            else:
                read, at = read + true[at], at + 1
        rows.append((true, read))
        assert scan_noise.align(true, read, {c: 1.0 for c in scan_noise.CONFUSIONS}) is not None
    got = spark.createDataFrame(rows, "t string, r string").select(
        scan_noise.skeleton(F.col("t")).alias("a"), scan_noise.skeleton(F.col("r")).alias("b")
    ).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_common_subsequence_bounds_matching_blocks():
    from difflib import SequenceMatcher

    rnd = random.Random(4)
    for _ in range(300):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 25)))
        b = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 25)))
        blocks = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert blocks <= scan_noise._common(a, b) <= min(len(a), len(b))


FACTS = "path string, sha256 string, edge_pages map<int, array<string>>, page_labels map<int, string>, meta string"


def test_faults_and_paragraphs(spark):
    line = "The gentle teacher measures the old garden every week and the"
    text = [line, "neighbour counts the well-worn tools before the garden closes.", line, "neighbour counts the well-worn tools before the garden clo-", "ses again. A teacher likes well-", "worn tools. Every fhing in fhe garden."]
    names = ["Ann", "Bob", "Cleo", "Dan", "Eve", "Flo", "Gus", "Hal", "Ida", "Joe", "Kit", "Liv", "Mia", "Ned", "Oda", "Pia"]
    pages = {p: [f"{names[p % 16]} {names[p // 16]} waits and {names[p // 2 % 16]} sees the garden,", *text, str(p)] for p in range(2, 40)}
    pages[50] = ["Liv says that a gentle teacher measures fhe old garden and tbe", "neighbour"]
    rows = [("b", "x", pages, {2: "2"}, None), ("b", "x", pages, {2: "2"}, None), ("c", "y", None, None, None), ("d", "z", {}, None, "{}")]
    df = spark.createDataFrame(rows, FACTS)
    got = {tuple(r) for r in scan_noise.line_faults(df).collect()}
    assert ("b", 2, 8, "furniture") in got and ("b", 2, 2, "furniture") not in got and ("b", 2, 5, "hyphen") in got
    assert ("b", 2, 6, "hyphen") not in got
    assert ("b", 50, 1, "misread") in got
    texts = [r["text"] for r in scan_noise.repaired_paragraphs(df).where("path = 'b'").orderBy("para_no").collect()]
    assert any("closes again. A teacher likes well-worn tools." in t for t in texts)
    assert any("measures the old garden and the neighbour" in t for t in texts)


# ---- abuse

def corpus(n=260, seed=4):
    rnd = random.Random(seed)
    nouns = ["garden", "roadmap", "invoice", "teacher", "market", "ladder"]
    clean = lambda: f"The {rnd.choice(nouns)} helps the {rnd.choice(nouns)} with {rnd.randint(2, 99)} notes."
    bad = lambda: f"You stupid {rnd.choice(['worm', 'swine', 'toad'])}, everyone hates you."
    docs, labels = [], []
    for i in range(n):
        parts = [clean() for _ in range(6)]
        abusive = i % 4 == 0
        if abusive:
            parts.insert(3, bad())
        elif i % 4 == 1:
            parts.insert(2, "I was stupid to skip the invoice.")
        docs.append((i, " ".join(parts), "src", abusive))
        if i < 200:
            labels.append((i, int(abusive), "insult" if abusive and i % 8 else None, "r1", None))
    return docs, labels


def test_abuse_scores_on_held_out_documents(spark):
    docs, labels = corpus()
    docs += [(900, None, "src", False), (901, "", None, False), (902, "YOU ST*PID sw1ne, everyone h a t e s you!", "src", True), (903, "...", "src", False)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, truth boolean")
    lab = spark.createDataFrame(labels + labels[:9], "doc_id long, abusive int, category string, rater string, labelled_at timestamp")
    got = {r["doc_id"]: r["any"] for r in abuse.abuse_scores(d, lab).collect()}
    held = [(got[i] >= 0.5, t) for i, _, _, t in docs if i >= 200]
    assert sum(a == t for a, t in held) >= 0.95 * len(held)
    assert got[900] == got[901] == got[903] == 0.0
    assert got[902] >= 0.5


def test_abuse_without_labels(spark):
    d = spark.createDataFrame([(1, "text", "s")], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, abusive int, category string, rater string, labelled_at timestamp")
    assert abuse.abuse_scores(d, lab).collect()[0]["any"] == 0.0


def test_disguises():
    assert abuse.plain_word("w0m@n") == "woman" and abuse.plain_word("brrrainless") == "brainles"
    assert abuse.tokens("a t a l k i n g dog w.h.o.l.e") [-1] == "whole"
