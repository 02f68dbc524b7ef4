"""Replays over a corpus of any size: no worker holds more of it than what its sessions have asked for.

A session begins with its hinted group and the next one. Where a rule needs a group that isn't there, or the best places in the whole corpus,
the session stops and asks; Spark answers all sessions' questions by joins, and these sessions start again with what they now know, until
none asks. The results are those of tracker.replay().
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadline.durable import durable
from threadline.functions.scores import span_scores
from threadline.functions.text import ARABIC, Profile, evidence_stems, split_words
from threadline.operators import corpus as corpora, search
from threadline.streaming.matching import GOOD_SINGLE, LONGEST_SPAN, SEEDS, WIDE, Hit, Index, Key, Window, build_index
from threadline.streaming.tracker import FIELDS, SCHEMA, Settings, State, Step, replay, run

#: What a session can ask for: a group's rows, the best rows of all for a text, and the best span at a group's opening.
GROUP, SEED, OPENING = "group", "seed", "opening"
#: Answers: the rows of a group (one without an ordinal where it has none); seeds with scores, and rows around them without; a span at an opening.
ANSWER = "session_id string, kind string, asked string, group_id int, ordinal int, ordinal_end int, score double, rank int, text string"
ASKED = f"{SCHEMA}, kind string, asked string, asked_group int"
SHOWN = pa.schema([(name, {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[kind]) for name, kind in (c.split() for c in ASKED.split(", "))])


class Asked(Exception):  # noqa: N818
    """A session can't go on without an answer."""

    def __init__(self, kind: str, text: str | None = None, group: int | None = None):
        super().__init__(kind)
        self.kind, self.text, self.group = kind, text, group


class _Known(dict):
    """What is known by key or group; looking into a group that isn't loaded asks for it."""

    def __init__(self, items: dict, loaded: set[int]):
        super().__init__(items)
        self.loaded = loaded

    def _of(self, key):
        group = key[0] if isinstance(key, tuple) else key
        if group not in self.loaded:
            raise Asked(GROUP, group=int(group))
        return key

    def __contains__(self, key) -> bool:
        return super().__contains__(self._of(key))

    def __getitem__(self, key):
        return super().__getitem__(self._of(key))

    def get(self, key, default=None):
        return super().get(self._of(key), default)


class Part(Index):
    """Some groups of a corpus of over WIDE rows, and what is known of all of it by the texts that were asked for: seeds, the best single rows
    in their order; near, the rows around these; openings, the best span at an opening, if there is any."""

    def __init__(self, rows: dict[Key, str], loaded: set[int], profile: Profile, seeds: dict[str, list[tuple[Key, float]]], near: dict[str, dict[Key, str]], openings: dict[str, list[Hit]]):
        super().__init__(rows, profile)
        self.rows, self.entries, self.groups = (_Known(x, loaded) for x in (self.rows, self.entries, self.groups))
        self.seeds, self.near, self.openings = seeds, near, openings

    def _seeds(self, w: Window) -> list[tuple[Key, float]]:
        if w.text not in self.seeds:
            raise Asked(SEED, w.text)
        return self.seeds[w.text]

    def best(self, w: Window, keys: list[Key] | None = None, threshold: float = 0.65, at: Key | None = None, exhaustive: bool = False) -> Hit | None:
        if keys is not None:
            return super().best(w, keys, threshold, at, exhaustive)
        if not w.text or threshold > 1:
            return None
        seeds = self._seeds(w)
        near = Index(self.near[w.text], self.profile)
        (key, score), *_ = seeds
        best = Hit(*key, None, near.rows[key], score)
        if exhaustive or best.score < GOOD_SINGLE:
            starts = dict.fromkeys((g, o - back) for (g, o), _ in seeds for back in range(LONGEST_SPAN) if (g, o - back) in near.rows)
            best = max([best, *near.spans(w, starts, at, True)], key=lambda h: h.score)
        if best.score < threshold and len(w.words) >= 3:
            if w.text not in self.openings:
                raise Asked(OPENING, w.text)
            best = max([best, *self.openings[w.text]], key=lambda h: h.score)
        return best if best.score >= threshold else None

    def ambiguous(self, w: Window, hit: Hit, tolerance: float = 0.005) -> bool:
        if hit.end is not None or not w.text:
            return False
        return any(score >= hit.score - tolerance for key, score in self._seeds(w) if key != hit.key)


def _part(answers: pa.Table, profile: Profile) -> Part:
    rows, loaded, seeds, near, openings = {}, set(), {}, {}, {}
    for a in sorted(answers.to_pylist(), key=lambda a: (a["rank"] is None, a["rank"] or 0)):
        key = None if a["ordinal"] is None else (a["group_id"], a["ordinal"])
        if a["kind"] == GROUP:
            loaded.add(a["group_id"])
            if key:
                rows[key] = a["text"]
        elif a["kind"] == SEED and a["score"] is None:
            near.setdefault(a["asked"], {})[key] = a["text"]
        elif a["kind"] == SEED:
            seeds.setdefault(a["asked"], []).append((key, a["score"]))
        else:
            openings.setdefault(a["asked"], []).extend([Hit(*key, a["ordinal_end"], a["text"], a["score"])] if key else [])
    return Part(rows, loaded, profile, seeds, near, openings)


def _answers(asked: DataFrame, corpus: DataFrame, profile: Profile) -> DataFrame:
    """Rows of ANSWER for session_id, kind, asked and asked_group."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = corpus.select("group_id", "ordinal", "text")
    of = asked.where(F.col("kind") == GROUP).select("session_id", F.col("asked_group").alias("group_id")).distinct()
    found = of.join(rows, "group_id", "left")
    out = found.select("session_id", F.lit(GROUP).alias("kind"), null("string", "asked"), "group_id", "ordinal", null("int", "ordinal_end"), null("double", "score"), null("int", "rank"), "text")

    seeking = asked.where(F.col("kind") == SEED).select("session_id", "asked").distinct()
    if not seeking.isEmpty():
        q = seeking.select(F.col("asked").alias("query_id"), F.col("asked").alias("text")).distinct().withColumn("words", split_words(F.col("text")))
        top = durable(search.top(q.withColumn("evidence", evidence_stems(F.col("words"), profile)), corpus, SEEDS, profile))
        around = top.select("query_id", "group_id", F.explode(F.sequence(F.col("ordinal") - LONGEST_SPAN + 1, F.col("ordinal") + LONGEST_SPAN - 1)).alias("ordinal")).distinct()
        near = around.join(rows, ["group_id", "ordinal"]).select("query_id", "group_id", "ordinal", null("double", "score"), null("int", "rank"), "text")
        both = top.select("query_id", "group_id", "ordinal", "score", F.col("rank").cast("int"), null("string", "text")).unionByName(near)
        both = both.join(seeking.withColumnRenamed("asked", "query_id"), "query_id")
        out = out.unionByName(both.select("session_id", F.lit(SEED).alias("kind"), F.col("query_id").alias("asked"), "group_id", "ordinal", null("int", "ordinal_end"), "score", "rank", "text"))

    opening = asked.where(F.col("kind") == OPENING).select("session_id", "asked").distinct()
    if not opening.isEmpty():
        starts = corpus.where("ordinal = first_ordinal").select("group_id", "ordinal")
        spans = corpora.spans(corpus).join(starts, ["group_id", "ordinal"], "left_semi").select("group_id", "ordinal", "ordinal_end", "text")
        pairs = search.spread(spans).crossJoin(F.broadcast(opening.select("asked").distinct()))
        scored = pairs.withColumn("score", span_scores(profile)("asked", "text", F.lit(True)))
        first = F.struct(F.col("score"), -F.col("group_id"), -F.col("ordinal"), -F.col("ordinal_end"))
        best = scored.groupBy("asked").agg(F.max_by(F.struct("group_id", "ordinal", "ordinal_end", "score", "text"), first).alias("b"))
        both = opening.join(best, "asked", "left")
        out = out.unionByName(both.select("session_id", F.lit(OPENING).alias("kind"), "asked", "b.group_id", "b.ordinal", "b.ordinal_end", "b.score", null("int", "rank"), "b.text"))
    return out


def replay_over(windows: DataFrame, corpus: DataFrame, profile: Profile = ARABIC, settings: Settings = Settings()) -> DataFrame:
    """tracker.replay() over a prepared corpus (see operators.corpus) of any size.

    A worker holds one session's windows, the groups it was in or near, and the rows around the 20 best for each text that it looked for
    everywhere. Each round is a pass of the corpus for what all sessions ask; a session asks for one thing in a round, so there are as many
    rounds as the longest list of questions of a session. A question to all rows meets every row that shares a stem with the text, as the
    search does, and one about openings all groups: that part is quadratic where every window asks, in blocks and without a table of pairs.
    """
    corpus = corpus.withColumn("group_id", F.col("group_id").cast("int"))
    if corpus.select("group_id").limit(WIDE + 1).count() <= WIDE:
        return replay(windows, build_index(corpus, profile), settings)

    def of_session(windows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if len(windows):
            session, ts, discovery, tracking, hints = (windows.column(c).to_pylist() for c in ("session_id", "ts", "discovery_text", "tracking_text", "hint"))
            hint = next((h for h in hints if h is not None), None)
            try:
                _, shown = run(State(hint=hint), list(zip(ts, discovery, tracking, strict=True)), session[0], Step(_part(answers, profile), settings))
                out = [(*s, None, None, None) for s in shown]
            except Asked as a:
                out = [(session[0], *[None] * (len(FIELDS) - 1), a.kind, a.text, a.group)]
        columns = zip(*out, strict=True) if out else [()] * len(SHOWN)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, SHOWN, strict=True)], SHOWN)

    own = windows.where("hint is not null").select("session_id", F.col("hint").cast("int").alias("hint")).distinct()
    asked = own.select("session_id", F.lit(GROUP).alias("kind"), F.lit(None).cast("string").alias("asked"), F.explode(F.array("hint", F.col("hint") + 1)).alias("asked_group"))
    known, left, done = None, windows, None
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as sessions are few in bytes and dear in work
    while True:
        new = _answers(asked, corpus, profile)
        known = durable(new if known is None else known.unionByName(new))
        both = left.repartition(tasks, "session_id").groupBy("session_id").cogroup(known.repartition(tasks, "session_id").groupBy("session_id"))
        found = durable(both.applyInArrow(of_session, ASKED))
        over = found.where("kind is null").select(*FIELDS)
        done = over if done is None else done.unionByName(over)
        asked = found.where("kind is not null").select("session_id", "kind", "asked", "asked_group")
        if asked.isEmpty():
            return done
        waiting = asked.select(F.col("session_id").alias("_s")).distinct()
        left = durable(windows.join(waiting, F.col("session_id").eqNullSafe(F.col("_s")), "left_semi"))
        known = known.join(waiting, F.col("session_id").eqNullSafe(F.col("_s")), "left_semi")
