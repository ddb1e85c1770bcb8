import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from sifter.llm import bpe, decontaminate, htmltext, langid, pii, toxicity
from sifter.llm.common import drawn


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_spec(bpe.default_vocabulary()))


def test_bpe_equals_the_library(encoder):
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(4)
    words = list(ref.get_vocab())
    signs = "aeinorstZÉ'éßΣς0123 .,!<|>\n\t\x1c\x85 ​日本😀ǅİKﬁ́"
    texts = ["", "   ", "Hello World's END", "<|endoftext|>a<|startoftext|>", "ΑΣ ΑΣΑ", "x" * 5000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(words).replace("</w>", rng.choice(["", " "])) for _ in range(5)) for _ in range(1500)]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        got = encoder.encode(t)
        assert got.tolist() == want, t
        assert encoder.decode(got).decode() == ref.decode(want, skip_special_tokens=False)
        assert encoder.spell(got).decode() == " ".join(map(str, want))


def test_bpe_rows(odd_docs, no_docs):
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    rows = bpe.encode_documents(odd_docs).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    key = lambda r: tuple(map(str, r))
    want = [(i, hashlib.sha256(" ".join(map(str, ref.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in texts]
    assert sorted(((r["doc_id"], r["ids_sha256"]) for r in rows), key=key) == sorted(want, key=key)
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in rows)
    assert bpe.encode_documents(no_docs).count() == 0


def _words(t):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination_against_scanning(llm, odd_docs):
    rng = random.Random(5)
    pool = ["alpha", "Beta", "gamma", "the", "the", "É", "é", "x1", "the"]
    text = lambda n: rng.choice(["", ".", " "]) + rng.choice([" ", ", ", "-"]).join(rng.choice(pool) for _ in range(n)) + rng.choice(["", "!"])
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(30)] + [(30, None), (31, "..."), (None, "alpha the"), (5, "the the")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, "")]
    docs += [(62 + k, "intro words " + (items[k][1] or "") + " more words") for k in range(12)]
    got = {r["doc_id"]: r for r in decontaminate.contamination(llm.createDataFrame(docs, "doc_id long, text string"),
                                                              llm.createDataFrame(items, "item_id long, text string"), window=10).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ws, hit, found = _words(t), set(), set()
        for item, it in items:
            iw = _words(it)
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == iw[s:s + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(ws), len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    bench = llm.createDataFrame([(1, "lazy dog again the quick brown fox number 17 jumps over")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns and clean.where("doc_id = 6").count() == 0 and clean.count() == odd_docs.count() - 1
    assert decontaminate.drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert decontaminate.drop_contaminated(odd_docs.limit(0), bench).count() == 0


def test_proximity_any_order_within_span(llm):
    items = llm.createDataFrame([(1, "zebra quartz violin")], "item_id long, text string")
    docs = llm.createDataFrame([(1, "violin a b quartz c zebra"), (2, "zebra " + "x " * 30 + "quartz violin"), (3, "zebra quartz")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(docs, items, span=10).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_words_whose_lower_case_depends_on_neighbours_match(llm):
    """Final sigma, dotted I, sharp S, ligatures: the words are the same words whatever stands around them."""
    tail = " c1 c2 c3 c4 c5 c6 c7 c8"
    heads = ["ΑΣ Β", "İ ẞ", "ﬁ ΟΔΟΣ", "K Å", "ΣΑΣ Σ", "ß SS"]
    items = llm.createDataFrame([(i, h + tail) for i, h in enumerate(heads)], "item_id long, text string")
    forms = [lambda h, t: h.replace(" ", ".") + t, lambda h, t: "(" + h.replace(" ", " - ") + ")" + t.upper(), lambda h, t: "x " + h + t + "Σ"]
    docs = [(10 * i + k, f(h, tail)) for i, h in enumerate(heads) for k, f in enumerate(forms)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(df, items).collect()}
    for i, _ in docs:
        assert (got[i]["n_hit"], got[i]["contaminated"]) == ((10, True) if i % 10 < 2 else (0, False)), docs[i // 10 * 3 + i % 10]
    assert {r["doc_id"] % 10 for r in decontaminate.drop_contaminated(df, items).collect()} == {2}


def test_proximity_of_long_items(llm):
    rng = random.Random(4)
    words = [f"term{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(words, n))) for i, n in enumerate((40, 47, 60, 12))]
    docs = []
    for i, text in items:
        ws = text.split()
        first = ws[:20]
        rng.shuffle(first)
        docs += [(10 * i, text), (10 * i + 1, " ".join(f"pad{k}" for k in range(30)) + " " + " ".join(first)), (10 * i + 2, " ".join(f"{w} " + "gap " * 25 for w in ws))]
    got = {r["doc_id"]: r for r in decontaminate.contamination(llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string")).collect()}
    for i, _ in items:
        assert [got[10 * i + k]["n_near"] for k in range(3)] == [1, 1, 0]
        assert [got[10 * i + k]["contaminated"] for k in range(3)] == [True, False, False]


def test_pii_one_person_keeps_one_name(llm):
    docs = llm.createDataFrame([
        (1, "Dr. John Smith came. Mr. Smith sat, Mr. John Smith spoke; Smith slept, John's dog and SMITH too. Smithson stayed."),
        (2, "Mrs. Smith and Mary Smith. Mrs. Mary Smith."),
        (3, "Доктор Анна Иванова и госпожа. Госпожа Иванова. Иванова ушла."),
        (4, "John Smith, whom no title names here."),
    ], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    m = re.fullmatch(r"Dr\. (\w+) (\w+) came\. Mr\. (\w+) sat, Mr\. (\w+) (\w+) spoke; (\w+) slept, (\w+)'s dog and (\w+) too\. Smithson stayed\.", out[1])
    assert m and m[1] == m[4] == m[7] and m[2] == m[3] == m[5] == m[6] == m[8] and "Smith " not in out[1] and "John" not in out[1]
    f = re.fullmatch(r"Mrs\. (\w+) and (\w+) (\w+)\. Mrs\. (\w+) (\w+)\.", out[2])
    assert f and f[1] == f[3] == f[5] == m[2] and f[2] == f[4] and f[2].endswith("a")
    r = re.fullmatch(r"Доктор (\w+) (\w+) и госпожа\. Госпожа (\w+)\. (\w+) ушла\.", out[3])
    assert r and r[2] == r[3] == r[4] and r[2].endswith("ова")
    assert out[4] == "John Smith, whom no title names here."
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "another").collect()}
    assert other[1] != out[1]
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")
    llm.conf.unset(pii.KEY_SETTING)
    drawn = pii.session_key(llm)
    assert len(drawn) == 64 and pii.session_key(llm) == drawn


def test_training_samples_are_drawn_however_small_the_share(llm):
    n = 200_000
    some = llm.range(n).where(drawn("x", ["id"], 5e-5)).count()
    assert 0 < some < 40
    assert llm.range(n).where(drawn("x", ["id"], 1e-12)).count() == 0 and llm.range(n).where(drawn("x", ["id"], 1.0)).count() == n
    docs = llm.range(300).selectExpr("id as doc_id", "concat('wort ', id) as text", "if(id < 280, 'de', 'en') as lang")
    assert langid.train(docs, per_language=40)[0] == ["de", "en"]
    with pytest.raises(RuntimeError):
        langid.train(docs, per_language=1e-9)
    with pytest.raises(RuntimeError):
        toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"), per_class=1e-9)
    pages = docs.selectExpr("doc_id as page_id", "concat('<p>', text) as html", "'' as url")
    with pytest.raises(RuntimeError):
        htmltext.fit(pages, sample=1e-9)


def test_rare_language_labels_are_named(llm, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = llm.createDataFrame([(i, f"the house number {i}", "en") for i in range(9)] + [(20 + i, f"das haus nummer {i}", "de") for i in range(5)] + [(99, "the tree", "xx-stray")],
                               "doc_id long, text string, lang string").withColumn("source", langid.F.lit("s"))
    with pytest.warns(UserWarning, match="xx-stray"):
        languages, model = langid.train(docs)
    assert languages == ["de", "en"]
    got = {r["doc_id"]: r["lang"] for r in langid.identify(langid.document_rows(docs), languages, model).collect()}
    assert got[99] == "en" and len(got) == 15


def test_pii_is_consistent_distinct_and_in_kind(llm, odd_docs, no_docs):
    docs = llm.createDataFrame([
        (1, "Call +1 (377) 555-0271 or +1 377 555 0271, mail Jean.Düpont@mail.example.com and jean.düpont@mail.example.com."),
        (2, "Host 10.0.0.7 and 010.000.000.007; card 4111 1111 1111 1111; SSN 123-45-6789; token 04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        (3, "Mrs. Anna Kovacs met Mr. Kovacs and Госпожа Анна Иванова. Version 2.0, year 2024, 3 apples."),
    ], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    import re
    phones = re.findall(r"\+1 \(?\d{3}\)?[ ]\d{3}[- ]\d{4}", out[1])
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "13775550271"
    mails = re.findall(r"\S+@\S+\.com", out[1])
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and "pont" not in out[1]
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", out[2])
    assert len(set(ips)) == 1 and all(0 < int(x) < 256 for x in ips[0].split("."))
    digits = [int(c) for c in re.search(r"card ([\d ]{19})", out[2])[1].replace(" ", "")]
    assert sum(d if k % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"token [0-9a-f]{40}$", out[2]) and re.search(r"SSN \d{3}-\d{2}-\d{4};", out[2])
    names = re.match(r"Mrs\. ([A-Z]\w+a) ([A-Z]\w+) met Mr\. ([A-Z]\w+) and Госпожа ([А-Я]\w+на) ([А-Я]\w+ова)\. Version 2\.0, year 2024, 3 apples\.$", out[3])
    assert names and "Kovacs" not in out[3]
    same = pii.pseudonymise(odd_docs, "k")
    assert same.columns == odd_docs.columns and same.count() == odd_docs.count() and pii.pseudonymise(no_docs, "k").count() == 0
    assert {r["text"] for r in same.where("doc_id in (1, 2, 4)").collect()} == {None, "", "one"}


def test_pii_collisions_are_moved(llm, monkeypatch):
    real = pii.surrogate
    few = lambda kind, form, attempt, key: pii.F.concat(pii.F.substr(real(kind, form, attempt, key), pii.F.lit(1), pii.F.lit(3)), pii.F.lit("-00-0000"))
    monkeypatch.setattr(pii, "surrogate", few)
    docs = llm.createDataFrame([(i, f"number {i:03d}-45-6789") for i in range(1, 90)], "doc_id long, text string")
    moved = pii.moved_forms(docs, "k")
    assert moved.count() > 0
    out = [r["text"] for r in pii.pseudonymise(docs, "k").collect()]
    assert len(out) == len(set(out)) == 89


def test_pii_addresses_of_any_script_and_few_surrogates(llm, monkeypatch):
    locals_ = ["山田太郎", "محمد", "דוד", "김철수", "さくら", "नमस्ते", "Գագիկ", "๑๒๓"]
    mails = [f"{x}@example.com" for x in locals_] + ["山田@例え.com", "_@-.com", "%@--.com", "Jo@EXAMPLE.com"]
    docs = llm.createDataFrame([(i, f"mail {m} now") for i, m in enumerate(mails)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    new = [out[i].removeprefix("mail ").removesuffix(" now") for i in range(len(mails))]
    assert len({m.lower() for m in new}) == len(mails) and not {m.lower() for m in new} & {m.lower() for m in mails}
    assert all(old not in now for old, now in zip(locals_, new))
    assert all("\u4e00" <= c <= "\u9fff" for c in new[0].split("@")[0][-4:]) and all("\u0590" <= c <= "\u05ff" for c in new[2].split("@")[0][-3:])
    # fewer surrogates of the same length than forms: x@y.com (676) and +1 22 33 (10,000)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    monkeypatch.setattr(pii, "CROWDED", 2)
    full = [f"{a}@{b}.com" for a in alphabet for b in alphabet] + [f"+1 {n // 100:02d} {n % 100:02d}" for n in range(10000)]
    docs = llm.createDataFrame([(i, m) for i, m in enumerate(full)], "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymise(docs, "k").collect()]
    assert len(set(got)) == len(full) and not set(got) & set(full)


def test_pii_names_with_inner_capitals_and_neutral_titles(llm):
    said = ["Mr. O'Brien", "Mr. O’Brien", "Mr. O'Brien's", "Mrs. Mary McDonald", "Ms. MacLeod-Jones", "Mr. SMITH", "Mr. Jean-Luc D'Arc", "Dr. Kovacs", "Prof. Dr. Müller",
            "Frau Dr. von", "Frau Dr. Weber-McKay", "Herr Prof. Dr. Weiß", "Доктор Живаго"]
    docs = llm.createDataFrame([(i, f"met {m} today") for i, m in enumerate(said)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    import re
    for i, (title, parts) in enumerate([("Mr. ", 1), ("Mr. ", 1), ("Mr. ", 1), ("Mrs. ", 2), ("Ms. ", 1), ("Mr. ", 1), ("Mr. ", 2), ("Dr. ", 1), ("Prof. Dr. ", 1),
                                        (None, 0), ("Frau Dr. ", 1), ("Herr Prof. Dr. ", 1), ("Доктор ", 1)]):
        if title is None:
            assert out[i] == f"met {said[i]} today"
            continue
        new = re.fullmatch(rf"met {re.escape(title)}([^\W\d_]+(?: [^\W\d_]+){{{parts - 1}}})('s)? today", out[i])
        assert new and not set(re.findall(r"\w{3,}", said[i].removeprefix(title))) & set(re.findall(r"\w{3,}", new[1])), out[i]
    assert out[0] == out[1] and out[2] == out[0].replace(" today", "'s today")
    plain = llm.createDataFrame([(1, "The Dr. said so; prof. and Mr. went. Mrs. Anna Kovacs, Drive Dr.")], "doc_id long, text string")
    assert re.fullmatch(r"The Dr\. said so; prof\. and Mr\. went\. Mrs\. \w+a \w+l, Drive Dr\.", pii.pseudonymise(plain, "k").first()["text"])


def test_toxicity_learns_held_out_and_interactions(llm, no_docs):
    rng = random.Random(6)
    filler = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        ws = rng.sample(filler, 30)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(ws + ["insult"] * a + ["group"] * b), int(a and b)))
    docs = llm.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, "")], "doc_id long, text string")
    labels = llm.createDataFrame([(i, y) for i, _, y in rows] + [(3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 602
    from zlib import crc32
    held = [(r["score"] >= 0.3, y) for i, _, y in rows if (r := got[i])["held_out"]]
    assert all(got[i]["held_out"] == (crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.95
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels.limit(0))).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) < 0.01


def test_language_evidence(llm, odd_docs, no_docs):
    say = {"en": "the thing that is with other words and the house", "de": "der hund und die katze sind nicht schlecht gewesen", "es": "el perro y la casa no son de los otros hombres"}
    docs = llm.createDataFrame([(i, say[x] + f" {i}", x) for i, x in enumerate(list(say) * 20)], "doc_id long, text string, lang string")
    languages, model = langid.train(docs)
    assert languages == ["de", "en", "es"]
    rows = [(i, say[x], x, x, f"{x}.site.org", "site.org") for i, x in enumerate(list(say) * 8)]
    rows += [(100, None, "de", None, "de.site.org", "site.org"), (101, "12 34 !!", None, None, None, None), (102, "", None, "es", "es.site.org", None), (None, say["en"], None, None, None, None)]
    got = {r["doc_id"]: r for r in langid.identify(llm.createDataFrame(rows, "doc_id long, text string, markup string, suffix string, host string, parent string"), languages, model).collect()}
    assert all(got[i]["lang"] == x for i, x in enumerate(list(say) * 8))
    assert got[100]["lang"] == "de" and got[102]["lang"] == "es" and got[101]["text_lang"] is None and got[None]["lang"] == "en"
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and not kept.where("text is null or trim(text) = ''").count() and kept.where("doc_id = 6").count() == 1
    assert langid.keep_identified(no_docs).count() == 0
