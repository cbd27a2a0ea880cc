import random
import re


from tidequery.llm import paragraph_dedup as pd

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))


def brute(docs, least=8, threshold=0.8):
    ps = [(d, k, w) for d, t in docs for k, x in enumerate((t or "").split("\n")) if len(w := words(x)) >= least]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, _, w in ps]
    up = list(range(len(ps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ps)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ps)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        if len(own) > 1:
            head = min((ps[i][0] is not None, ps[i][0] or 0, ps[i][1]) for i in own)
            head = (head[1] if head[0] else None, head[2])
            out += [(ps[i][0], ps[i][1], 0, len(ps[i][2]), *head, len(own), (ps[i][0], ps[i][1]) != head) for i in own]
    return sorted(out, key=repr)


def corpus(seed=9):
    r = random.Random(seed)
    line = lambda n: [r.choice("abcdefghijklmnopqrst") * r.randint(1, 3) for _ in range(n)]
    base, docs = [line(r.randint(3, 60)) for _ in range(40)], []
    for i in range(90):
        own = []
        for _ in range(r.randint(0, 4)):
            x = list(r.choice(base)) if r.random() < 0.6 else line(r.randint(1, 50))
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = "ZZ"
            own.append(r.choice([" ", ", "]).join(x).upper() if r.random() < 0.3 else " ".join(x))
        docs.append((i, "\n".join(own)))
    return [*docs, (500, None), (501, ""), (502, "\n\n"), (None, docs[0][1] + "\n" + docs[1][1]), (503, " ".join(line(20_000)))]


def test_bands():
    b = pd.bands_for(0.8, 0.9995, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9995 > 1 - (1 - 0.8**5) ** (b - 1)


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(a, b, 1.5, "x") for a, b in docs], "doc_id long, text string, cls double, key string")
    want = brute(docs)
    for block, most in ((pd.BLOCK, pd.BROADCAST), (3, 0)):
        got = pd.repeated_paragraphs(df, min_words=8, block=block, broadcast=most, passage=10**6).collect()
        assert sorted([tuple(x) for x in got], key=repr) == want
    assert want and any(x[-1] for x in want)


def test_repeated_rows_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert [(x.members, x.cluster_doc_id) for x in pd.repeated_paragraphs(df).collect()] == [(2, 1), (2, 1)]
    assert pd.repeated_paragraphs(df.limit(0)).count() == 0


def test_passages_inside_of_lines(spark):
    r = random.Random(3)
    sentence = lambda n: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (7, 12, 9, 14, 9))
    long_ = passage + " " + " ".join(sentence(10) for _ in range(6))
    line = lambda *x: " ".join(x)
    docs = [(1, passage), (2, line(sentence(30), passage, sentence(40))), (3, line(passage, sentence(3))), (4, line(sentence(60), sentence(30))), (5, long_), (6, line(sentence(30), long_)), (7, f"{sentence(9)}\n{long_}"), (None, line(sentence(20), passage))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (pd.BROADCAST, 0):
        got = pd.repeated_paragraphs(df, broadcast=most).collect()
        assert {x.doc_id for x in got} == {1, 2, 3, 5, 6, 7, None}
        at = {(x.doc_id, x.paragraph, x.first_word): x for x in got}
        assert at[2, 0, 30].n_words == 51 and at[2, 0, 30].members == 8 and at[1, 0, 0].n_words == 51
        assert at[5, 0, 0].n_words == 111 and (5, 0, 7) not in at and not at[5, 0, 0].removed and at[7, 1, 0].removed
        assert sum(not x.removed and x.cluster_doc_id == x.doc_id and x.n_words == 51 and x.first_word in (0, 20) for x in got) == 1


def test_passages_over_lines_and_sentences_match_brute_force(spark):
    r = random.Random(5)
    some = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    shared, docs = [some(n) for n in (51, 60, 90, 140)], []
    for i in range(24):
        x = some(r.randint(5, 80))
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared)
            x += p[r.choice([0, 0, 20]) :] + some(r.randint(1, 40))
        ends = [r.choice([" ", " ", " ", "\n", ". "]) if k % 8 else "\n" for k in range(len(x))]
        docs.append((i, x, "".join(a + b for a, b in zip(x, ends, strict=True))))
    at = {}
    for i, x, _ in docs:
        for k in range(len(x) - 49):
            at.setdefault(tuple(x[k : k + 50]), []).append((i, k))
    want = {(i, k + j) for own in at.values() if len(own) > 1 for i, k in own for j in range(50)}
    got = set()
    for x in pd.repeated_paragraphs(spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")).collect():
        own, text = docs[x.doc_id][1:]
        start = len(words("\n".join(text.split("\n")[: x.paragraph]))) + x.first_word
        got |= {(x.doc_id, start + k) for k in range(x.n_words)}
        copies = sorted(c for c in at[tuple(own[start : start + 50])] if docs[c[0]][1][c[1] : c[1] + x.n_words] == own[start : start + x.n_words])
        assert x.members == len(copies) > 1 and x.cluster_doc_id == copies[0][0] and x.removed == ((x.doc_id, start) != copies[0])
    assert got == want and len(want) > 500


def test_a_kept_line_has_its_passages(spark):
    r = random.Random(6)
    some = lambda n: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(n))
    p = some(60) + "."
    line = f"{some(30)}. {p} {some(40)}."
    df = spark.createDataFrame([(1, f"{some(70)}. {p} {some(50)}."), (5, line), (9, line)], "doc_id long, text string")
    got = {(x.doc_id, x.first_word, x.n_words): (x.cluster_doc_id, x.members, x.removed) for x in pd.repeated_paragraphs(df).collect()}
    assert got[1, 70, 60] == (1, 3, False) and got[5, 30, 60] == (1, 3, True)
    assert got[5, 0, 130] == (5, 2, False) and got[9, 0, 130] == (5, 2, True) and (9, 30, 60) not in got
