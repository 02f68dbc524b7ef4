import collections
import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadline.llm import decontamination, langid, licenses, mixing, neardup, qualityrules, sharding, surrogates, urlfilter
from threadline.llm.components import components, joined

KEY = "a key of the tests"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _kept string"
PLAIN = "the river carries small boats past quiet villages and old stone bridges every single morning before the market opens for trade in town"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "a", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and a column named like an inner one."""
    df = documents(spark, [None, "", PLAIN, PLAIN, "é ß!", "word " * 30_000], ["a", None, "a", "b", "b", "a"])
    return df.union(df.where("doc_id = 2")).union(spark.createDataFrame([(None, PLAIN, None, None, None, None)], SCHEMA))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_shards_are_even_and_gapless(spark):
    df = documents(spark, ["t"] * 1003, ["abc"[i % 10 // 4] for i in range(1003)])
    rows = sharding.assign_shards(df, 8).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
        share = sum(r["source"] == "a" for r in shard) / len(shard)
        assert abs(share - sum(r["source"] == "a" for r in rows) / len(rows)) < 0.02


def test_shards_of_odd_rows(odd, empty):
    assert sharding.assign_shards(odd, 8).count() == 8
    assert sharding.assign_shards(empty, 8).count() == 0
    assert sharding.assign_shards(odd, 2).columns == [*odd.columns, "shard", "slot"]


def test_mix_reaches_targets(spark):
    df = documents(spark, ["w " * (1 + i % 7) for i in range(600)], [("a", "b", None)[i % 3] for i in range(600)])
    plan = mixing.allocate(df.select("doc_id", "source", mixing.word_count("text").alias("size")), [3.0, 1.0, 2.0])
    per = plan.groupBy("_source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n")).collect()
    for r in per:
        assert abs(r["taken"] - r["target"]) <= 14 and r["target"] <= 2 * r["n"] + 1e-6
    assert sum(r["target"] for r in per) == pytest.approx(1.5 * sum(r["n"] for r in per))
    assert mixing.mix_sources(df, [3.0, 1.0, 2.0]).count() == plan.agg(F.sum("times")).first()[0]


def test_mix_of_odd_rows(odd, empty):
    assert mixing.mix_sources(odd, [3.0, 1.0, 2.0]).columns == odd.columns
    assert mixing.mix_sources(empty, [3.0, 1.0, 2.0]).count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for k, item in items:
        x = words(item)
        n = min(13, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("words", [1 << 20, 1 << 10])
def test_decontamination(spark, odd, empty, monkeypatch, words):
    monkeypatch.setattr(decontamination, "SCREEN_WORDS", words)
    items = [(1, PLAIN), (10, "Small BOATS!"), (2, ""), (3, None), (4, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [PLAIN + " more", "small boats. Small, boats", None, "nothing here", "x " + PLAIN.upper()])
    rows = decontamination.contamination(docs, bench, ["doc_id", "text"]).select("*", decontamination.words_hit(F.col("_hits")).alias("n")).collect()
    for r in rows:
        assert (r["_n_words"], r["n"], r["_items"]) == brute_hits(r["text"], items)
    assert decontamination.decontaminate(odd, bench).columns == odd.columns
    assert decontamination.contamination(empty, bench, ["doc_id"]).count() == 0
    assert decontamination.decontaminate(odd, bench.where("false")).count() == 8


def test_urls(spark):
    rules = (urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "a.net", "/en/"))
    urls = ["http://A.NET/en/x", "http://b.a.net/x?y#z", "https://www.bad.org/p/?utm_source=q", "http://bad.org/p", "no url", None, "http://good.org/p", "http://anet/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    listed = spark.createDataFrame([("https://bad.org/p/index.html",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, listed, rules).collect()}
    assert got == {
        0: ("a.net", "/en/x", "a.net/en/", "allow"),
        1: ("b.a.net", "/x", "net/", "block"),
        2: ("www.bad.org", "/p/", None, "block"),
        3: ("bad.org", "/p", None, "block"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("good.org", "/p", None, "allow"),
        7: ("anet", "/x", None, "allow"),
    }
    assert urlfilter.judge_urls(pages, listed.where("false"), rules).where("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    urls = spark.range(5000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("u"))
    blocks, words = urlfilter.bloom_blocks(urls, "u")
    test = urlfilter.in_bloom(blocks, words, spark)(F.xxhash64("u"), F.xxhash64("u", F.lit(1)))
    assert urls.where(test).count() == 5000
    others = spark.range(5000, 25000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("u"))
    assert others.where(test).count() < 1000


def test_quality_counts():
    texts = [PLAIN + "\n" + PLAIN + "\n\n" + PLAIN, "", None, "a b c a b c #*$", "é\tß\n é\n é", "x"]
    got = qualityrules.count_features(pa.record_batch([pa.array(texts)], names=["t"]))
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        times = collections.Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert tuple(row[:5]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def test_quality_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in qualityrules.judge(odd).collect()}
    assert got[(0, 0)]["base_failed"] and not got[(0, 0)]["kept"] and got[(5, 30_000)]["base_failed"]
    assert qualityrules.judge(empty).count() == 0


def test_near_duplicates(spark, odd, empty):
    random = np.random.default_rng(3)
    words = ["w%d" % i for i in range(500)]
    text = lambda: random.choice(words, 120).tolist()
    base, texts = text(), []
    texts = [" ".join(base), " ".join(base), " ".join(base[:60] + ["zz"] + base[61:]), *[" ".join(text()) for _ in range(10)], "", ""]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got[0] == got[1] == got[2] == 0 and [got[i] for i in range(3, 13)] == list(range(3, 13)) and got[13] == got[14] == 13
    assert neardup.drop_near_duplicates(documents(spark, texts)).count() == 12
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert neardup.near_duplicates(empty).count() == 0


def test_samples_follow_similarity():
    random = np.random.default_rng(1)
    h = random.integers(1, 1 << 63, 1500, dtype=np.uint64)
    weight = random.choice([0.5, 1.0, 2.0], 1500)
    sampler = neardup.Sampler(600)
    a, b = np.arange(0, 1100), np.arange(300, 1500)
    same = (sampler.of(h[a], weight[a], np.array([0])) == sampler.of(h[b], weight[b], np.array([0]))).mean()
    both = weight[300:1100].sum()
    assert abs(same - both / (weight[a].sum() + weight[b].sum() - both)) < 0.06


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and len(got) == 33


def _roots(edges):
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    random = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2)) if a != b]
    edges += [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    more = [(130, 200), (5, 110)]
    known = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in known.collect()} == _roots(edges)
    after = joined(known, spark.createDataFrame(more, "a long, b long"))
    assert {r["node"]: r["root"] for r in after.collect()} == _roots(edges + more)
    assert joined(known, spark.createDataFrame([], "a long, b long")) is known


def test_language_model_survives_packing():
    model = langid.build({"x": [b"one two three one two"], "y": ["zw\u00f6lf elf zehn".encode(), b"drei"]})
    again = pickle.loads(pickle.dumps(model))
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True)) and len(pickle.dumps(model)) < sum(t.nbytes for t in model.tables)


def test_languages(spark, odd, empty):
    random = np.random.default_rng(2)
    sets = {"xx": "ka ki ko ku sa si so".split(), "yy": "ber gar dol fum hin".split()}
    rows = [(i, " ".join("".join(random.choice(sets[l], 3)) for _ in range(40)), l) for i, l in enumerate(["xx", "yy"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train(df.where(~langid.held_out()))).where(langid.held_out()).collect()
    assert {r["doc_id"] for r in got} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd_rows = langid.identify(odd, langid.train(df)).collect()
    assert all((r["lang_pred"] == "und") == (not re.search("[a-zé]", r["text"] or "")) for r in odd_rows)
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_licenses(spark, odd, empty):
    texts = ["x\nReleased under the MIT License.\ny", "Licensed under the Apache License,\nVersion 2.0", "no licence", None]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert got == {0: ["MIT"], 1: ["Apache-2.0"], 2: [], 3: []}
    assert licenses.scan_licenses(odd).count() == 8 and licenses.scan_licenses(empty).count() == 0


def test_licenses_of_both_views(spark):
    wrapped = "Licensed under the Apache License,\nVersion 2.0."
    texts = ["Released under the MIT License\nsome words\n\n" + wrapped, wrapped + "\n\nReleased under the MIT License\nsome words", "Released under the MIT License.\n" * 2]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    both = ["MIT", "Apache-2.0"]
    assert got == {0: (["mit.released", "apache2.licensed"], both), 1: (["apache2.licensed", "mit.released"], both), 2: (["mit.released"] * 2, ["MIT"])}


def test_no_known_sentence_is_screened_out(spark):
    texts = ["All **rights** reserved.", "x\n\nAll rights\n * reserved.", "Every Cat_may be petted!", "none"]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert got == {0: ["LicenseRef-AllRightsReserved"], 1: ["LicenseRef-AllRightsReserved"], 2: [], 3: []}
    own = licenses.scan_licenses(documents(spark, texts), {"cat": "every cat may be petted", "no": "none"}, (licenses.Rule("CAT", ("cat",)), licenses.Rule("NO", ("no",))))
    assert {r["doc_id"]: r["licenses"] for r in own.collect()} == {0: [], 1: [], 2: ["CAT"], 3: ["NO"]}
    bare = [*licenses.SENTENCES.values()]
    scanned = licenses.scan_licenses(documents(spark, [s.upper().replace(" ", " ** ") for s in bare])).collect()
    assert all(r["sentence_ids"] == [[*licenses.SENTENCES][r["doc_id"]]] for r in scanned)


def test_surrogates(spark, odd, empty):
    texts = ["mail a.b7@mail3.example.com from 10.20.30.40 or +1 (988) 555-2485, card 4539578763621486", "a.b7@mail3.example.com again, Mrs. Anna Berg", None, PLAIN]
    got = {r["doc_id"]: r for r in surrogates.replace_entities(documents(spark, texts), KEY).collect()}
    new = got[0]["text"]
    for e in ("a.b7@", "10.20.30.40", "988", "4539578763621486", "Anna"):
        assert e not in new + got[1]["text"]
    email = re.search(r"\S+@\S+\.org", new)[0]
    assert email in got[1]["text"] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and "Mrs. " in got[1]["text"]
    card = re.search(r"\d{16}", new)[0]
    assert sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(card)) % 10 == 0
    assert got[2]["text"] is None and got[3]["text"] == PLAIN and got[3]["n_entities"] == 0
    ips = spark.range(3000).select(F.concat_ws(".", F.lit("9"), F.lit("8"), (F.col("id") / 250).cast("int").cast("string"), (F.col("id") % 250).cast("string")).alias("text"))
    assert surrogates.replace_entities(ips, KEY).select("text").distinct().count() == 3000
    assert surrogates.replace_entities(odd, KEY).columns == [*odd.columns, "n_entities", "kinds"] and surrogates.replace_entities(empty, KEY).count() == 0


def test_surrogates_of_exhausted_formats(spark, monkeypatch):
    values = [str(i) for i in range(10)] + [f"{i:02}" for i in range(100)]
    texts = [f"password={v}" for v in values] + ["password=3 password=x7y", "none", None]
    few = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(documents(spark, texts), KEY).collect()}
    new = [few[i].removeprefix("password=") for i in range(len(values))]
    assert len(set(new)) == len(values) and not set(new) & set(values)
    assert few[110].startswith(few[3] + " password=") and few[111] == "none" and few[112] is None
    monkeypatch.setattr(surrogates, "MOST_EXCEPTIONS", 3)
    assert {r["doc_id"]: r["text"] for r in surrogates.replace_entities(documents(spark, texts), KEY).collect()} == few


def test_secrets_in_any_case(spark):
    texts = ['TOKEN = "9233A8EC00B1"', 'Token = "9233a8ec00b1"', "PASSWORD=Xy7pq", 'token = "9233A8EC00B1"']
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(documents(spark, texts), KEY).collect()}
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{12}"', got[0]) and re.fullmatch(r'Token = "[0-9a-f]{12}"', got[1]) and re.fullmatch(r"PASSWORD=[A-Z][a-z]\d[a-z]{2}", got[2])
    assert all(got[i] != t for i, t in enumerate(texts)) and got[3] == got[0].replace("TOKEN", "token")


def test_titles_decide_gender_and_later_mentions_follow(spark):
    texts = [
        "Mr. George Blake met Mrs. Ann Martin. Later George Blake left, and Blake paid; Annual talks went on with Martin.",
        "Dr. George Blake wrote to Herr Blake.",
        "Frau Robin Stone, г-жа Анна Иванова и г-н Петр Иванов. Иванов ушел.",
        "Blake without a title stays.",
    ]
    got = {r["doc_id"]: r for r in surrogates.replace_entities(documents(spark, texts), KEY).collect()}
    first = re.fullmatch(r"Mr\. (\w+ron) (\w+) met Mrs\. (\w+na) (\w+)\. Later (\w+) (\w+) left, and (\w+) paid; Annual talks went on with (\w+)\.", got[0]["text"])
    george, blake, ann, martin = first.groups()[:4]
    assert first.groups()[4:] == (george, blake, blake, martin) and len({george, blake, ann, martin}) == 4
    assert got[1]["text"] == f"Dr. {george} {blake} wrote to Herr {blake}."
    assert re.fullmatch(r"Frau \w+na \w+, г-жа \w+на \w+ина и г-н \w+рон (\w+ин)\. \1 ушел\.", got[2]["text"])
    assert got[3]["text"] == texts[3] and got[0]["n_entities"] == 6 and got[0]["kinds"] == ["name"]
    other = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(documents(spark, texts), "another key").collect()}
    assert george not in other[0] and blake not in other[0]
    with pytest.raises(ValueError):
        surrogates.replace_entities(documents(spark, texts), "")


def test_names_are_distinct_and_coherent(spark, monkeypatch):
    """3,000 surnames, each in a full name, after a title and by itself; against a replacement in plain Python, word by word."""
    name = lambda i: "Q" + "".join("abcdefghij"[int(c)] for c in f"{i:04}") + "k"
    texts = [f"Mr. Al{'bcde'[i % 4]}o {name(i)} came. Later {name(i)} said so." for i in range(3000)]
    texts += [f"Dr. Al{'bcde'[i % 4]}o {name(i)} came. Mr. {name(i)} left, and {name(i + 1)} stayed." for i in range(3000)]
    texts += ["Mrs. Albo Qaaaak met Ms. Qaaabk Stone. Qaaabk Stone and Albo left.", "Mr. Alco. Alco Qaaack, Mr. Qaaack."]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(documents(spark, texts), KEY).collect()}
    names, new = {}, {}
    for i, text in enumerate(texts):
        titled = re.findall(r"(?:Mr|Dr|Mrs|Ms)\. (\w+)(?: ([A-Z]\w+))?", text)
        made = re.findall(r"(?:Mr|Dr|Mrs|Ms)\. (\w+)(?: ([A-Z]\w+))?", got[i])
        for w, n in zip(sum(titled, ()), sum(made, ())):
            assert bool(w) == bool(n) and names.setdefault(w, n) == n and new.setdefault(n or w, w) == w
    assert len(names) == len(new) == 3000 + 4 + 2 and not set(new) & set(names) - {""}
    for i, text in enumerate(texts):
        own = set(sum(re.findall(r"(?:Mr|Dr|Mrs|Ms)\. (\w+)(?: ([A-Z]\w+))?", text), ()))
        assert got[i] == re.sub(r"\w+", lambda m: names[m[0]] if m[0] in own else m[0], text)
    few = documents(spark, texts[2990:3010] + texts[-2:])
    monkeypatch.setattr(surrogates, "NAME_SYLLABLES", 1)  # 53 names, so that most clash
    some = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(few, KEY).collect()}
    monkeypatch.setattr(surrogates, "MOST_EXCEPTIONS", 3)
    assert {r["doc_id"]: r["text"] for r in surrogates.replace_entities(few, KEY).collect()} == some
    made = {m for t in some.values() for m in re.findall(r"[A-Z][a-z]+(?:ler|ron|na)\b", t)}
    assert len(made) == len({w for t in texts[2990:3010] + texts[-2:] for w in re.findall(r"Q\w+|Al[bcde]o|Stone", t)} - {name(10)})


HEADERS = {
    "GPL-3.0-or-later": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


def test_headers_as_they_are_written(spark):
    df = documents(spark, list(HEADERS.values())).withColumn("licenses", F.lit("x"))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(df).collect()}
    assert got == {i: [name] for i, name in enumerate(HEADERS)}
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES) and {s for r in licenses.RULES for s in r.sentences} <= set(licenses.SENTENCES)


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_urls_of_odd_tables(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", most)
    urls = ["http://a.org/x", "http://a.org/x", None, "", "no url", "http://b.org/y?utm_source=z", "HTTP://B.org/y/", "http://c.org/" + "p" * 100_000, "://", "http://"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[0], None)], "page_id int, url string, host string").withColumns({c: F.lit(3) for c in ("_c", "_kept", "verdict", "_hit", "_may")})
    listed = spark.createDataFrame([("https://www.a.org/x/",), ("http://b.org/y",), (None,), ("http://a.org/x",), ("x",)], "url string")
    got = urlfilter.judge_urls(pages, listed)
    assert got.columns == ["page_id", "url", "_c", "_kept", "_hit", "_may", "host", "path", "rule", "listed", "verdict"]
    rows = collections.Counter((r["page_id"], r["host"], r["verdict"]) for r in got.collect())
    want = {(0, "a.org", "block"): 2, (1, "a.org", "block"): 1, (None, "a.org", "block"): 1, (2, "", "allow"): 1, (3, "", "allow"): 1, (4, "", "allow"): 1, (5, "b.org", "block"): 1, (6, "b.org", "block"): 1, (7, "c.org", "allow"): 1, (8, "", "allow"): 1, (9, "", "allow"): 1}
    assert rows == want
    assert urlfilter.judge_urls(pages.where("false"), listed).count() == 0


def test_removed_spans(spark):
    item = " ".join(f"w{i}" for i in range(13))
    texts = ["Before, " + item.upper() + "! after", "nothing Here", None, item, "w0 w1 " + item + " w2"]
    df = documents(spark, texts).withColumn("_hits", F.lit("x"))
    got = decontamination.remove_spans(df, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: "before after", 1: "nothing Here", 2: None, 3: "", 4: "w0 w1 w2"} and got.columns == df.columns


def test_no_window_slips_through_the_screen(spark):
    """Windows of every length at every place of a document."""
    random = np.random.default_rng(0)
    word = lambda: "".join(random.choice(list("abcdefgh"), 6))
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 18)]
    texts = [" ".join([word() for _ in range(at)] + items[n - 1][1].split()[:13] + [word() for _ in range(5)]) for n in range(1, 18) for at in range(0, 15)]
    rows = decontamination.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"]).select("*", decontamination.words_hit(F.col("_hits")).alias("n")).collect()
    for r in rows:
        assert (r["_n_words"], r["n"], r["_items"]) == brute_hits(r["text"], items)
    assert len(rows) == len(texts) and all(r["n"] for r in rows)


def test_training_on_repeated_and_null_ids(spark):
    sets = {"xx": "ka ki ko ku sa si so".split(), "yy": "ber gar dol fum hin".split()}
    random = np.random.default_rng(5)
    text = lambda lang: " ".join("".join(random.choice(sets[lang], 3)) for _ in range(30))
    one = text("xx")
    rows = [(7, one, "xx")] * 300 + [(7, text("xx"), "xx") for _ in range(20)] + [(None, text("yy"), "yy") for _ in range(50)] + [(1, None, "xx"), (2, text("xx"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    per_text = len(langid.symbols(np.frombuffer(one.encode() + b"\n", np.uint8), np.array([0, len(one) + 1]), model.symbol)[0])
    assert model.languages == ["xx", "yy"] and model.lengths[0] <= 21 * 1.2 * per_text  # the repeated text counts once
    assert [r["lang_pred"] for r in langid.identify(df.where("text is not null"), model).collect()] == ["xx"] * 320 + ["yy"] * 50 + ["xx"]
    assert [tuple(t.tolist()) for t in langid.train(df.repartition(5)).tables] == [tuple(t.tolist()) for t in model.tables]


def test_long_documents_teach_a_window(spark, monkeypatch):
    rows = [(1, "ka ki ko " * 50_000, "xx"), (2, "ber gar dol " * 10, "yy")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["xx", "yy"] and 1000 < model.lengths[0] <= langid.SAMPLE_CHARS + 1
    assert langid._shares([5, 100, 100], 65) == [5, 30, 30] and langid._shares([1, 2], 10) == [1, 2]


def test_languages_of_many_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, f"word{i} text", f"l{i % 5}") for i in range(23)]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["l0", "l1", "l2"]


def test_clashing_names(spark):
    df = documents(spark, [PLAIN, "mail a@b.example.com"]).withColumns({c: F.lit("x") for c in ("_text", "_found", "_gaps", "n_entities", "lang_pred", "_letters", "sentence_ids", "_source", "_t0", "_f")})
    assert surrogates.replace_entities(df, KEY).count() == 2 and licenses.scan_licenses(df).count() == 2
    assert sharding.assign_shards(df, 2).columns == [*df.columns, "shard", "slot"] and langid.keep_languages(df, langid.build({"x": [b"ab"]})).columns == df.columns
    assert mixing.mix_sources(df, [1.0]).columns == df.columns


def test_licenses_of_a_text_of_hits(spark):
    """100,000 known sentences in one text: every one is found, in time that follows their number."""
    import time

    known = next(s for s in licenses.SENTENCES.values() if s == "all rights reserved")
    name = next(k for k, s in licenses.SENTENCES.items() if s == known)
    df = spark.createDataFrame([(1, "All rights reserved.\n" * 100_000)], "doc_id int, text string")
    scanned = licenses.scan_licenses(df).select(F.size("sentence_ids").alias("n"), F.array_distinct("sentence_ids").alias("ids"))
    scanned.where("n > 0").count()
    began = time.time()
    assert tuple(scanned.first()) == (100_000, [name])
    assert time.time() - began < 30  # the square of that number would take hours


def test_sums_before(spark):
    sizes = [i % 11 for i in range(1000)]
    df = spark.createDataFrame([(sizes,), (sizes[:1],), ([],)], "v array<int>").select(licenses._sums_before(F.col("v")).alias("s"))
    assert [r["s"] for r in df.collect()] == [[sum(sizes[:i]) for i in range(1000)], [0], []]
