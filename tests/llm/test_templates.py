import random

from cindersift.llm import decontaminate as dec

ITEM = "Natalia sold 48 clips to her friends in April. Natalia then sold half as many clips in May for 3 dollars. How many clips did Natalia sell altogether in April and May?"
FILLER = "the quick brown fox jumps over a lazy dog while rain falls on old stones near the river"


def swapped(name, n, price, month="April"):
    return ITEM.replace("Natalia", name).replace("48", n).replace(" 3 ", f" {price} ").replace("April", month)


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in dec.matches(docs, bench).collect()}


def test_reparameterised_questions_are_found(spark):
    texts = [ITEM, swapped("Maria", "62", "7"), f"{FILLER}\n{swapped('Ivan', '5', '11', 'June')} {FILLER}", f"{swapped('Maria', '62', '7')} {FILLER} {swapped('Omar', '9', '4')}", FILLER, None, ""]
    assert found(spark, texts) == {(i, 0) for i in range(4)}


def test_inconsistent_slots_are_no_question(spark):
    rng = random.Random(2)
    words = ITEM.split()
    mixed = " ".join(w if w not in ("Natalia", "April", "April.", "May", "May?") else rng.choice(["Ada", "Bob", "Cy", "Di", "Ed", "Flo"]) for w in words)
    assert found(spark, [mixed.replace("48", "1").replace("Natalia", "Gus")]) <= {(0, 0)}
    assert found(spark, [FILLER * 40]) == set()


def test_windows_against_brute_force(spark):
    """Coverage of exact templates by plain sets of 5-word windows."""
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 30))) for _ in range(20)]
    texts = []
    for i in range(40):
        base = items[i % 20].split()
        cut = base[: rng.randrange(5, len(base) + 1)]
        texts.append(" ".join([rng.choice(vocab) for _ in range(20)] + cut + [rng.choice(vocab) for _ in range(20)]))
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if len(grams(t) & grams(q)) >= 0.8 * len(grams(q))}
    assert found(spark, texts, items) == want and len(want) > 10
