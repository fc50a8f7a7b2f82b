import random
import re

from strataline.llm import repeats as R

from .frames import HARD, documents, exchanges, prose


def brute(rows, min_words):
    seen, docs = {}, {}
    rank = lambda i, t: (i is None, i or 0, t or "")
    for i, t, _, _ in rows:
        docs[i, t] = [(p, s, e, " ".join(w)) for p, (s, e, w) in enumerate(R.units(t or ""))]
        for p, _, _, w in docs[i, t]:
            seen[w] = min(seen.get(w, (rank(i, t), p)), (rank(i, t), p))
    out = []
    for i, t, _, _ in rows:
        later = [(p, s, e, w) for p, s, e, w in docs[i, t] if seen[w] != (rank(i, t), p)]
        runs = []
        for u in later:
            if runs and runs[-1][-1][0] + 1 == u[0]:
                runs[-1].append(u)
            else:
                runs.append([u])
        spans = [(r[0][1], r[-1][2]) for r in runs if sum(len(u[3].split()) for u in r) >= min_words]
        text = t
        for s, e in reversed(spans):
            text = text[:s] + text[e:]
        out.append((i, text, spans))
    return sorted(out, key=repr)


def test_units_cover_the_words():
    text = "  One two. Three\n\n four!  five?six \t\nseven.  "
    assert [(text[s:e], w) for s, e, w in R.units(text)] == [("One two.", ["one", "two."]), ("Three", ["three"]), ("four!", ["four!"]), ("five?six", ["five?six"]), ("seven.", ["seven."])]
    assert list(R.units("")) == [] and list(R.units(" \n ")) == []


def test_matches_brute_force(spark):
    passage = ". ".join(prose(90 + k, 12) for k in range(5)) + "."
    rows = HARD + [(100 + k, f"{prose(k, 30)} {passage}\n{prose(1000 + k, 9)}. Er. Tion was.\nAll rights reserved.", "en", "s") for k in range(30)]
    rows.append((999, passage + " " + passage, "en", "s"))
    for least in (1, 10):
        out = R.remove_repeats(documents(spark, rows, True), min_words=least)
        assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.columns[-2:] == ["__spans", "__n_removed"]
        got = sorted([(r["doc_id"], r["text"], [(s["start"], s["stop"]) for s in r["__spans"]]) for r in out.collect()], key=repr)
        assert got == brute(rows, least)
    # the passage stays where it came first, and short common sentences stay everywhere
    kept = {r["doc_id"]: r["text"] for r in R.remove_repeats(documents(spark, rows)).collect()}
    assert passage in kept[100] and all(prose(93, 12) not in kept[k] for k in range(101, 130)) and "Er. Tion was." in kept[120]


def test_rows_with_the_same_id_and_no_rows(spark):
    rows = [(1, "a b c d e f g h i j k l.", "en", "s"), (1, "A b c d e f g h i j  k l.", "en", "s")]
    assert sorted(len(r["__spans"]) for r in R.remove_repeats(documents(spark, rows), min_words=10).collect()) == [0, 1]
    assert R.remove_repeats(documents(spark, [])).count() == 0


def covered(texts, whole_passages):
    """Characters that go: runs of repeated units, and what is repeated beyond them. ``whole_passages``: only passages of PASSAGE words that
    occur as a whole in an earlier place; else every run of that length whose GRAM-word windows have all occurred earlier."""
    size = R.PASSAGE if whole_passages else R.GRAM
    words, first = {}, {}
    for i, t in sorted(texts.items()):
        at = [m.span() for m in re.finditer(r"\S+", t or "")]
        words[i] = at, [t[a:b].lower() for a, b in at]
        for p in range(len(at) - size + 1):
            first.setdefault(tuple(words[i][1][p:p + size]), (i, p))
    out = {i: {c for a, b in spans for c in range(a, b)} for i, _, spans in brute([(i, t, None, None) for i, t in texts.items()], R.MIN_WORDS)}
    for i, (at, said) in words.items():
        later = [first[tuple(said[p:p + size])] != (i, p) for p in range(len(said) - size + 1)]
        p = 0
        while p < len(later):
            z = p
            while z < len(later) and later[z]:
                z += 1
            if z > p and z - p + size - 1 >= R.PASSAGE:
                out[i] |= set(range(at[p][0], at[z + size - 2][1]))
            p = max(z, p + 1)
    return out


def held_against_brute_force(texts, got):
    """All whole passages go, and nothing that has not occurred earlier."""
    least, most = covered(texts, True), covered(texts, False)
    for i, t in texts.items():
        text, spans = got[i]
        gone = {c for a, b in spans for c in range(a, b)}
        assert least[i] <= gone <= most[i]
        assert text == (t and "".join(c for k, c in enumerate(t) if k not in gone))
    return least, most


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in R.op6_substring_dedup(spark, sf_dir).collect():
        got[r["doc_id"]] = r["text"], [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]
        assert r["removed_chars"] == len(texts[r["doc_id"]] or "") - len(r["text"] or "")
    least, most = held_against_brute_force(texts, got)
    assert sum(least[i] == most[i] for i in texts) > 0.9 * len(texts)


def test_passages_of_many_lengths_and_neighbours(spark):
    rng = random.Random(12)
    source = [[f"s{k}w{i}" for i in range(200)] for k in range(4)]
    texts = {}
    for i in range(60):
        said = prose(300 + i, 15).split()
        for _ in range(rng.randrange(4)):
            k, n = rng.randrange(4), rng.choice([10, 24, 25, 26, 49, 50, 51, 75, 76, 120, 200])
            p = rng.randrange(201 - n)
            said += [*source[k][p:p + n], *prose(rng.randrange(10 ** 6), rng.randrange(3)).split()]
        texts[i] = " ".join(said)
    texts[60], texts[61] = texts[5], None
    rows = [(i, t, "en", "s") for i, t in texts.items()]
    got = {r["doc_id"]: (r["text"], [(s["start"], s["stop"]) for s in r["__spans"]]) for r in R.remove_repeats(documents(spark, rows), passages=True).collect()}
    held_against_brute_force(texts, got)


def test_clashing_columns_come_back(spark):
    rows = [(k, "one two three four five six seven eight nine ten eleven.", k * 10, f"t{k}", k) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __d int, __t string, __own int")
    got = sorted((r["doc_id"], r["text"], r["__d"], r["__t"], r["__own"]) for r in R.remove_repeats(df, passages=True).collect())
    assert got == [(k, t if k == 0 else "", d, x, o) for k, t, d, x, o in rows]


def test_passages_pasted_into_lines_and_repeated_lines(spark):
    # 51 words in one, two and three sentences, without a sentence end where they are pasted
    word = lambda k: [f"w{k}x{i}" for i in range(51)]
    said = []
    for k in range(3):
        w = word(k)
        for cut in ([], [25], [16, 33])[k]:
            w[cut] += "."
        said.append(" ".join(w))
    line = "this line of just twelve words is found again in every text."
    rows = [(10 * k + n, f"{prose(50 + 10 * k + n, 20)} before{n} {p} after{n} {prose(80 + 10 * k + n, 20)}\n{line}", "en", "s") for k, p in enumerate(said) for n in range(4)]
    for r in R.remove_repeats(documents(spark, rows, True), passages=True).collect():
        k, n = divmod(r["doc_id"], 10)
        whole = rows[4 * k + n][1]
        want = whole if n == 0 else whole.replace(said[k], "")
        assert r["text"] == (want if r["doc_id"] == 0 else want.replace(line, ""))
        assert "".join(whole[a:b] for (a, b) in zip([0, *[s["stop"] for s in r["__spans"]]], [*[s["start"] for s in r["__spans"]], len(whole)])) == r["text"]


def test_every_passage_holds_a_sampled_window():
    text = prose(1, 400)
    every = R.windows(text)
    at = set(R.sampled(every).tolist())
    assert len(every) == 376 and len(at) < 100 and all(at & set(range(p, p + R.REACH)) for p in range(len(every) - R.REACH + 1))
    shared = R.windows("other words " + text)
    assert (shared[2:] == every).all() and not len(R.windows(prose(1, 49)))


def test_normal_units_and_places_agree_on_odd_texts():
    cuts = re.compile(r"[.!?]+\s+|\n\s*")
    rng = random.Random(3)
    for k in range(3000):
        text = "".join(rng.choice("aΣ.!?\n \t\x85\u3000\U0001f600\ud800İ") for _ in range(rng.randrange(25)))
        ends = [0, *[m.end() for m in cuts.finditer(text)], len(text)]
        want = [(a, b) for a, b in zip(ends, ends[1:]) if text[a:b].split()]
        want = [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip()), text[a:b].lower().split()) for a, b in want]
        assert list(R.units(text)) == want
        assert R.normal(text) == [" ".join(words).encode("utf-8", "surrogatepass") for _, _, words in want]


def test_digests_on_many_rows_are_dealt_to_several_tasks(spark, monkeypatch):
    rows = [(a, a % 3, doc, 0, R.WINDOW + doc % 7 if a % 2 else doc % 7, 1 + doc % 4, a * doc % 2, doc % (1 + a)) for a, n in ((-5, 3), (0, 900), (1, 1), (2, 1), (3, 40), (8, 700), (9, 500), (11, 6)) for doc in range(n)]
    rows += [(9, 1, 4000, 0, R.WINDOW, 1, 0, 0), *rows[5:400:7]]
    df = spark.createDataFrame(rows, R._UNITS_DDL)
    got = []
    monkeypatch.setattr(R, "HELD", 16)
    for hot in (R.HOT, 100):
        monkeypatch.setattr(R, "HOT", hot)
        monkeypatch.setattr(R, "FEW", 1)
        got.append(R._settled(df, df).select("doc", "tie", "place", "n", "later", "mixed", "same_before", "same_behind").collect())
    want = []
    for a, b, doc, tie, place, n, _, _ in rows:
        group = [r for r in rows if r[:2] == (a, b)]
        later = (doc, tie, place) != min(r[2:5] for r in group)
        same = [len({r[k] for r in group}) == 1 for k in (6, 7)]
        mixed = place >= R.WINDOW and not all(same)
        if later or mixed:
            want.append((doc, tie, place, n, later, mixed, *same))
    cleared = lambda r: r if r[5] else (*r[:6], None, None)
    for out in got:
        assert sorted((cleared(tuple(r)) for r in out), key=repr) == sorted(map(cleared, want), key=repr)


def test_a_unit_goes_through_one_exchange(spark, monkeypatch):
    moved = []

    def kept(df):
        rows = df.collect()
        moved.extend(exchanges(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(R, "materialise", kept)
    said = [prose(k, 12) + "." for k in range(30)]
    rows = [(k, " ".join([*said, prose(100 + k, 12)]), "en", "s") for k in range(60)]
    out = R.remove_repeats(documents(spark, rows))
    assert sum(r["__n_removed"] for r in out.collect()) == 59 * 30
    moved += exchanges(out._jdf.queryExecution().executedPlan())
    assert 60 * 31 <= sum(n for columns, n in moved if "a" in columns) < 1.2 * 60 * 31
