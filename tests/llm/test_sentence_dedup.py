import random

from lanegraph.llm import sentence_dedup as s

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    """Sentences with the white space behind them, character by character."""
    out, k, n = [], 0, len(text)
    while text[k:].strip(SPACE):
        j = k
        while text[j] in SPACE:
            j += 1
        j += 1
        while j < n:
            q = j + 1
            while text[j] in ".!?。！？" and q < n and text[q] in "\"'”’»)]":
                q += 1
            if text[j] == "\n" or text[j] in "。！？" or (text[j] in ".!?" and q < n and text[q] in SPACE):
                while q < n and text[q] in SPACE:
                    q += 1
                j = q
                break
            j += 1
        out.append(text[k:j])
        k = j
    return out


def kept(texts, run):
    """The texts without the sentences of runs seen before, in the order of the list."""
    seen, out = set(), []
    for t in texts:
        parts = split(t or "")
        gone = set()
        for p in range(len(parts) - run + 1):
            w = tuple(x.strip(SPACE) for x in parts[p : p + run])
            gone |= set(range(p, p + run)) if w in seen else set()
            seen.add(w)
        out.append("".join(x for p, x in enumerate(parts) if p not in gone) if parts else t or "")
    return out


def planted(seed=3):
    r = random.Random(seed)
    pool = [" ".join("".join(r.choices("abcdé", k=r.randint(1, 6))) for _ in range(r.randint(1, 6))) for _ in range(25)]
    ends = [". ", "! ", "?\n", "\n", '." ', ".  \n\t", "。", ".x ", " ", "\n\n\n"]
    texts = ["".join(r.choice(pool) + r.choice(ends) for _ in range(r.randint(0, 40))) for _ in range(60)]
    shared = "One here. Two there. Three at last. "
    return texts + [None, "", " \n\t ", "...", "\n\n" + pool[0], "Own. " + shared + "End.", shared.strip(), "A start. " + shared, "Lone. Pair. "] + ["Same. " * 9]


def run(spark, texts, n=s.RUN):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in s.deduplicate(docs, run=n).collect()}
    for k, want in enumerate(kept(texts, n)):
        assert got[k]["kept_text"] == want, k
        assert got[k]["n_sentences"] - got[k]["n_cut"] == len(split(want)) or got[k]["n_cut"] > 0
        assert got[k]["n_sentences"] == len(split(texts[k] or ""))


def test_documents_are_brute_force(spark):
    run(spark, planted())
    run(spark, planted(4), 2)


def test_shuffled_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(s, "SENT_ITEMS", 0)
    run(spark, planted(5))


def test_short_passage_is_cut_and_first_stays(spark):
    passage = "A line of text. And one more here. The third ends it. "
    assert len(passage) < 400
    docs = spark.createDataFrame([(2, "Behind comes this. " + passage), (1, passage + "Own end."), (1, passage + "Own end.")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["kept_text"]) for r in s.deduplicate(docs).collect())
    assert got == [(1, passage + "Own end.")] * 2 + [(2, "Behind comes this. ")]


def test_odd_rows(spark, odd_docs, no_docs):
    out = s.deduplicate(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and {"score", "n_words"} <= set(out.columns)
    by = {r["doc_id"]: r for r in rows}
    # null, empty, white space, and texts of one sentence keep everything
    assert [(by[k]["kept_text"], by[k]["n_cut"]) for k in range(5)] == [("", 0), ("", 0), (" \n\t ", 0), ("one", 0), ("one two three", 0)]
    assert [by[k]["n_sentences"] for k in range(4)] == [0, 0, 0, 1]
    two = s.deduplicate(spark.createDataFrame([(1, "A b. C d."), (2, "A b. C d."), (3, "A b. C d. E f."), (4, "A b. C d. E f.")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["n_cut"], r["kept_text"]) for r in two} == {1: (2, 0, "A b. C d."), 2: (2, 0, "A b. C d."), 3: (3, 0, "A b. C d. E f."), 4: (3, 3, "")}
    assert s.deduplicate(no_docs).count() == 0
