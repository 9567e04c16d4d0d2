import random
from collections import Counter

import pytest

from barloom.llm import contamination as leaks

from .frames import documents, empty


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(k, f"{text(rng.randint(10, 40))}.\n{text(rng.randint(3, 12))}.") for k in range(60)]
    docs = [text(rng.randint(1, 400)) for _ in range(40)]
    planted = []
    for k in range(20):
        item = items[3 * k][1]
        docs.append(f"{text(rng.randint(0, 300))} {item.upper()} {text(rng.randint(0, 300))}")
        planted.append((len(docs) - 1, items[3 * k][0]))
    return items, docs, planted


def brute_scores(index, words, stride):
    """Every passage's best share of each item, term by term."""
    out = Counter()
    steps = -(-len(words) // stride)
    for passage in range(max(1, steps - 1)):
        terms = {index.terms[w] for w in words[passage * stride:(passage + 2) * stride] if w in index.terms}
        score = Counter()
        for t in terms:
            for item, x in zip(index.items[t], index.shares[t]):
                score[item] += x
        for item, x in score.items():
            out[item] = max(out[item], x)
    return out


def index_of(items, settings):
    rows = [(k, t.encode()) for k, t in items]
    holders = Counter(w for _, t in rows for w in set(leaks.words_of(t)))
    mean = sum(len(leaks.words_of(t)) for _, t in rows) / len(rows)
    return leaks.ItemIndex.build(rows, holders, len(rows), mean, settings)


@pytest.mark.parametrize("share", [0.2, 0.35, 0.5])
def test_search_finds_all_above_the_threshold(share):
    items, docs, _ = corpus()
    settings = leaks.LeakSettings(share=share)
    index = index_of(items, settings)
    for text in docs:
        words = leaks.words_of(text.encode())
        ids = leaks.np.array([index.terms.get(w, len(index.items)) for w in words])
        found = Counter()
        for passage, block in index.hopeful(ids):
            begin = passage * settings.stride
            terms = [t for t in leaks.np.unique(ids[begin:begin + 2 * settings.stride]).tolist() if t < len(index.items)]
            for item, score in index.search(terms, block):
                found[item] = max(found[item], score)
        want = {k: round(v, 9) for k, v in brute_scores(index, words, settings.stride).items() if v >= share}
        assert {k: round(v, 9) for k, v in found.items()} == want


def test_planted_items_are_found_and_clean_documents_stay(spark):
    items, docs, planted = corpus()
    frame = documents(spark, docs + [None, ""])
    benchmark = spark.createDataFrame([*items, (None, "no id here at all"), (99, None), (98, "  ")], "item_id long, text string")
    found = leaks.benchmark_leaks(frame, benchmark)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted(planted)
    assert leaks.benchmark_leaks(empty(frame), benchmark).count() == 0
    assert leaks.benchmark_leaks(frame, empty(benchmark)).count() == 0
    kept = leaks.with_leaks(frame, benchmark, "_leaks")
    assert kept.columns == [*frame.columns, "_leaks"] and kept.count() == frame.count()


def test_parts_of_the_index_give_the_same_result(spark):
    items, docs, planted = corpus(8)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    small = leaks.LeakSettings(index_bytes=4000)
    assert len(list(leaks.item_indexes(benchmark, small))) > 2
    got = [sorted(map(tuple, leaks.benchmark_leaks(frame, benchmark, s).collect())) for s in (leaks.LeakSettings(), small)]
    assert [x[:2] for x in got[0]] == sorted(planted)
    assert [(a, b, round(c, 9), d, e, f) for a, b, c, d, e, f in got[0]] == [(a, b, round(c, 9), d, e, f) for a, b, c, d, e, f in got[1]]


def test_question_and_answer():
    assert leaks.question_and_answer(b"What is it? It is x.") == ([b"what", b"is", b"it"], [b"it", b"is", b"x"])
    assert leaks.question_and_answer(b"A b.\nC d.\n") == ([b"a", b"b"], [b"c", b"d"])
    assert leaks.question_and_answer(b"only words") == ([b"only", b"words"], [])


def test_long_items_are_found_at_every_offset():
    rng = random.Random(12)
    items, _, _ = corpus()

    def text(n):
        return " ".join(f"v{rng.randint(0, 3000)}" for _ in range(n))

    sizes = [64, 65, 129, 256, 300, 600, 1000]
    long = [(100 + n, f"{text(n - n // 5)}.\n{text(n // 5)}.") for n in sizes]
    index = index_of([*items, *long], leaks.LeakSettings())
    for item, whole in long:
        for offset in (0, 17, 64, 111):
            found = index.leaks(f"{text(offset)} {whole.upper()} {text(200)}".encode())
            assert [(h["item_id"], h["question_overlap"], h["answer_overlap"]) for h in found] == [(item, 1.0, 1.0)]
        quoted = " ".join(whole.split()[:20])
        assert index.leaks(f"{text(100)} {quoted} {text(200)}".encode()) == []
    first = " ".join(long[-1][1].split()[:64])
    found = index.leaks(f"{first} {text(2500)} {long[-1][1]}".encode())
    assert [h["item_id"] for h in found] == [1100]
