
import itertools

from gleanery.llm import eval_leaks
from gleanery.llm import near_duplicates as nd


def test_large_class_links_all_its_texts(spark):
    n = nd.EXPANDED_CLASS + 5
    orders = itertools.islice(itertools.permutations("alpha beta gamma delta eps".split()), n)
    texts = [(f"t{i:03d}", " ".join(w)) for i, w in enumerate(orders)]
    copies = [(f"u{i:03d}", "alpha beta gamma delta eps!") for i in range(n)]
    other = [("z", "alpha beta gamma delta")]
    df = spark.createDataFrame(texts + copies + other + texts[:3], "id string, text string")
    got = {(r["key_a"], r["key_b"]) for r in nd.similar_records(df, "t", "id", "text").collect()}
    stand = [k for k, _ in texts] + ["u000", "z"]
    want = set(itertools.combinations(stand, 2)) | {("u000", k) for k, _ in copies[1:]}
    assert got == want


def test_one_wrong_word_is_found_at_every_offset():
    item = [f"w{i}" for i in range(31)]
    matcher = eval_leaks.Matcher([(1, " ".join(item))])
    for at in range(len(item) - eval_leaks.PASSAGE + 1):
        for wrong in range(eval_leaks.PASSAGE):
            passage = item[at:at + eval_leaks.PASSAGE]
            passage[wrong] = "x"
            assert matcher.distances(" ".join(["", "a", "b", *passage, "c", "d", ""])) == {1: 1}, (at, wrong)
