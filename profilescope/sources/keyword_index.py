"""A keyword index kept beside a stored table: postings by token, a gram dictionary, term statistics.

Layout under the table's folder::

    index/log/            numbered manifests: which table commit the index is at, and its parts
    index/parts/<name>/   postings/tb=<n>/    by hash of the token, sorted by it
                          dictionary/gb=<n>/  grams of 2 and 3 characters to the words that hold them
                          statistics/         signed document frequencies
                          touched/            ids whose postings in earlier parts no longer count

``refresh`` reads the batches committed since the last time, makes the postings of just the documents that they change,
and adds them as a part. The document frequencies of a part are signed: what the new versions add less what the old ones
had. Readers sum them up, and take a document's postings from the last part that touched it. ``compact`` makes one part of
all. A search reads the token buckets of the tokens it asks for.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilescope.functions import text
from profilescope.functions.keywords import EXACT, SUBSTRING, WORD
from profilescope.operators.changelog import OP, UPSERT
from profilescope.operators.joins import BROADCAST_ROWS, hot_join, is_small, written_once
from profilescope.operators.postings import PHRASE, _posted
from profilescope.operators.relevance import boosts, norm
from profilescope.schema import TEXT_FIELDS
from profilescope.session import COMPRESSION
from profilescope.sources.commitlog import SharedFiles, State, dumped, loaded
from profilescope.sources.tables import BUCKET, StoredTable

TOKEN_BUCKETS, SALTS = 16, 8
#: Parts from which a refresh makes one of all.
MANY_PARTS = 8
#: Documents whose postings a task sorts: from so many on a further task is worth it, and at most about so many.
FEWEST, MOST = 256, 4096
GRAMS = (2, 3)
POSTING = "mode string, token string, id long, field string, freq long, norm double, places array<struct<item:int,spot:int>>"


def _bucket(column: str, of: int) -> Column:
    return F.pmod(F.hash(column), F.lit(of))


def _counted(items: str) -> str:
    """Of an array of structs with a ``token`` an array of ``token, own``: each distinct token with its elements.

    A document's elements are sorted and cut into runs inside its row. They need no exchange and no aggregation of
    rows, of which there would be one for each word of each text.
    """
    first = "i = 0 OR NOT (get(sorted, i).token <=> get(sorted, i - 1).token)"
    run = "slice(sorted, at + 1, coalesce(get(starts, j + 1), size(sorted)) - at)"
    runs = f"transform(starts, (at, j) -> named_struct('token', get(sorted, at).token, 'own', {run}))"
    starts = f"filter(transform(sorted, (x, i) -> CASE WHEN {first} THEN i END), at -> at IS NOT NULL)"
    # An array of one value is looked through to name that value, which is then made once.
    whole = f"flatten(transform(array({starts}), starts -> {runs}))"
    return f"flatten(transform(array(sort_array({items})), sorted -> {whole}))"


def document_postings(profiles: DataFrame, buckets: int = TOKEN_BUCKETS, tasks: int | None = None) -> DataFrame:
    """``mode, token, id, field, freq, norm, places, tb`` of every token of every field.

    Substring mode has the words between white space, whole-word mode the analysed words with their places (value
    and position), exact mode the values. Ids are unique, as in a stored table. Profiles are dealt out to ``tasks`` tasks, which
    make the postings where they then are: those are many times as large, and a frequent token is in all tasks alike.
    """
    place = "named_struct('item', item, 'spot', spot)"
    none = "cast(array() AS array<struct<item:int,spot:int>>)"
    content = text.content("items")
    spots = f"transform({text.word_positions('value')}, (t, spot) -> named_struct('token', t, 'place', {place}))"
    placed = f"flatten(transform(items, (value, item) -> coalesce({spots}, array())))"
    kept = f"filter({placed}, x -> x.token <> {text.literal(text.STOPPED)})"

    def bare(tokens: str) -> str:
        return f"transform({tokens}, t -> named_struct('token', t))"

    def posted(mode: str, tokens: str, places: str) -> str:
        found = f"named_struct('mode', '{mode}', 'token', x.token, 'freq', cast(size(x.own) AS bigint), 'places', {places})"
        return f"transform({_counted(tokens)}, x -> {found})"

    words = posted(SUBSTRING, bare(text.whitespace_tokens(text.lowercase("content"))), none)
    every = [
        f"CASE WHEN content <> '' THEN {words} ELSE array() END",
        posted(EXACT, bare("items"), none),
        posted(WORD, kept, "x.own.place"),
    ]
    names = text.literals(list(TEXT_FIELDS))
    dealt = profiles.repartition("id") if tasks is None else profiles.repartition(tasks, "id")
    fields = dealt.selectExpr("id", f"posexplode({text.all_fields()}) AS (f, items)")
    # Norms are made before the tokens are exploded: beside the explosion they would be made for each of them.
    normed = fields.selectExpr("id", f"array({names})[f] AS field", "f", "items", f"{content} AS content").selectExpr(
        "id", "field", "items", "content", f"{boosts(EXACT)}[f] AS exact_norm",
        f"{norm('content', f'{boosts(SUBSTRING)}[f]', SUBSTRING)} AS substring_norm",
        f"{norm('content', f'{boosts(WORD)}[f]', WORD)} AS word_norm",
    )
    found = normed.selectExpr(
        "id", "field", "exact_norm", "substring_norm", "word_norm",
        f"explode(concat({', '.join(f'coalesce({x}, array())' for x in every)})) AS found",
    )
    chosen = f"CASE found.mode WHEN '{SUBSTRING}' THEN substring_norm WHEN '{EXACT}' THEN exact_norm ELSE word_norm END"
    rows = found.selectExpr(
        "found.mode AS mode", "found.token AS token", "id", "field", "found.freq AS freq", f"{chosen} AS norm", "found.places AS places",
    )
    return rows.withColumn("tb", _bucket("token", buckets))


def _dictionary(postings: DataFrame, buckets: int) -> DataFrame:
    """(gram, word, gb): the words of substring mode by the short grams of their delimited tokens."""
    words = postings.where(F.col("mode") == SUBSTRING).select(F.col("token").alias("word")).distinct()
    grams = " , ".join(text.grams_of_length("form", str(n)) for n in GRAMS)
    of_forms = f"flatten(transform({text.delimited_tokens('word')}, form -> concat({grams})))"
    held = words.select("word", F.expr(f"explode(array_distinct({of_forms}))").alias("gram"))
    return held.select("gram", "word", _bucket("gram", buckets).alias("gb"))


def _frequencies(postings: DataFrame, sign: int) -> DataFrame:
    counted = postings.where(F.col("mode") != SUBSTRING).groupBy("mode", "field", "token").agg(F.count(F.lit(1)).alias("df"))
    return counted.select("mode", "field", "token", (F.col("df") * sign).alias("df"))


def _times(form: Column, term: Column) -> Column:
    """How often a term occurs in a text, overlaps included."""
    quoted = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.regexp_count(form, F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")))


class KeywordIndex:
    """The index of one stored table of profiles.

    ``buckets`` says how many buckets tokens are hashed to; what the first refresh takes holds for the index.
    """

    def __init__(self, table: StoredTable, buckets: int = TOKEN_BUCKETS):
        self.table, self.spark, self.buckets = table, table.spark, buckets
        self.files = SharedFiles(table.spark, os.path.join(table.folder, "index"))

    def manifest(self) -> dict | None:
        names = [name for name, _ in self.files.names("log") if not name.startswith(".")]
        return json.loads(self.files.read("log", names[-1])) if names else None

    def _publish(self, manifest: dict, last: dict | None) -> bool:
        """Whether no other refresh came first."""
        manifest["number"] = last["number"] + 1 if last else 0
        return self.files.create(json.dumps(manifest), "log", f"{manifest['number']:020d}.json")

    def refresh(self) -> int:
        """Bring the index up to the table's last commit; returns that commit's number.

        Without an index, after a reset, or if a vacuum removed what is needed to tell the old versions, it is built anew.
        """
        last, state = self.manifest(), self.table.state()
        of = last["buckets"] if last else self.buckets
        if last and last["through"] == state.number:
            return state.number
        folders = self._changes_since(last, state) if last else None
        name = f"parts/{uuid.uuid4().hex}"
        if folders is None:
            rows = self.table._merged(state)
            count = self._write(name, of, rows, None, None)
            parts, documents = [{"folder": name, "touched": 0}], count
        elif not folders:
            parts, documents, name = last["parts"], last["documents"], None
        else:
            old_state, key = loaded(last["state"]), self.table.spec.key
            changed = written_once(self.table.keys_of(folders), "changed")
            touched, few = changed.count(), is_small(changed)
            ids = F.broadcast(changed) if few else changed

            def version(of: State) -> DataFrame:
                named = {r[0] for r in changed.select(self.table._bucket(state.buckets)).distinct().collect()}
                found = self.table._current(of, named)
                return found.where(F.col(OP) == UPSERT).join(ids, key, "left_semi")

            new, old = version(state), written_once(version(old_state), "old-versions")
            count = self._write(name, of, new, old, changed)
            parts = [*last["parts"], {"folder": name, "touched": touched}]
            documents = last["documents"] + count - old.count()
        manifest = {"through": state.number, "documents": documents, "parts": parts, "buckets": of, "state": dumped(state)}
        if not self._publish(manifest, last):
            if name:
                self.files.delete(name)
            return self.refresh()
        if len(parts) > MANY_PARTS:
            self.compact()
        return state.number

    def _changes_since(self, last: dict, state: State) -> list[str] | None:
        """The folders of batches committed after the index's commit; None if they or the old versions can't be told."""
        commits = self.table.log.commits(last["through"], state.number)
        if commits is None or any(c["kind"] == "reset" for c in commits):
            return None
        folders = [c["folder"] for c in commits if c["kind"] == "changes"]
        old = loaded(last["state"])
        needed = [*folders, *(c["folder"] for c in old.tail), *(f"{f}/{BUCKET}={b}" for b, f in old.snapshot.items())]
        return folders if all(self.table.log.files.exists(f) for f in needed) else None

    def _path(self, *parts: str) -> str:
        return os.path.join(self.files.folder, *parts)

    def _write(self, name: str, of: int, new: DataFrame, old: DataFrame | None, touched: DataFrame | None) -> int:
        """One part; returns the number of documents in it."""
        new = written_once(new.select(*self.table.spec.schema.fieldNames()), "new-versions")
        count = new.count()
        rows = document_postings(new, of, self._tasks(count)).sortWithinPartitions("tb", "mode", "token", "id")
        rows.write.partitionBy("tb").parquet(self._path(name, "postings"), compression=COMPRESSION)
        postings = self._read(name, "postings", f"{POSTING}, tb int")
        self._write_dictionary(name, postings, of)
        counted = _frequencies(postings, 1)
        if old is not None:
            signed = counted.unionAll(_frequencies(document_postings(old, of, self._tasks(old.count())), -1))
            counted = signed.groupBy("mode", "field", "token").agg(F.sum("df").alias("df")).where("df <> 0")
        counted.sortWithinPartitions("mode", "token").write.parquet(self._path(name, "statistics"))
        if touched is not None:
            touched.select(F.col(self.table.spec.key).alias("id")).write.parquet(self._path(name, "touched"))
        return count

    def _tasks(self, documents: int) -> int:
        """Tasks that make postings: as many as run at a time, unless they would have few documents or too many to sort."""
        return max(1, documents // MOST, min(documents // FEWEST, self.spark.sparkContext.defaultParallelism))

    def _write_dictionary(self, name: str, postings: DataFrame, of: int) -> None:
        """The dictionary of a part, by tasks that have the distinct words: their grams, many times as large, don't move."""
        dictionary = _dictionary(postings, of).sortWithinPartitions("gb", "gram", "word")
        dictionary.write.partitionBy("gb").parquet(self._path(name, "dictionary"), compression=COMPRESSION)

    def _read(self, part: str, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(part, kind))

    def _whole(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        """The postings that count, of the token buckets asked for."""
        parts = manifest["parts"]
        found = []
        for place, part in enumerate(parts):
            rows = self._read(part["folder"], "postings", f"{POSTING}, tb int")
            rows = rows if buckets is None else rows.where(F.col("tb").isin(list(buckets)))
            found.append(rows.withColumn("_part", F.lit(place)))
        rows = reduce(DataFrame.unionAll, found)
        if len(parts) == 1:
            return rows.drop("_part")
        named = [
            self._read(part["folder"], "touched", "id long").withColumn("_last", F.lit(place))
            for place, part in enumerate(parts)
            if place
        ]
        last = reduce(DataFrame.unionAll, named).groupBy("id").agg(F.max("_last").alias("_last"))
        if sum(part["touched"] for part in parts) <= BROADCAST_ROWS:
            last = F.broadcast(last)
        return rows.join(last, "id", "left").where("_part >= coalesce(_last, 0)").select(*found[0].drop("_part").columns)

    def compact(self) -> None:
        """Make one part of all."""
        last = self.manifest()
        if last is None or len(last["parts"]) == 1:
            return
        name, of = f"parts/{uuid.uuid4().hex}", last["buckets"]
        rows = self._whole(last).repartition("tb", F.pmod(F.hash("id"), F.lit(SALTS)))
        rows = rows.sortWithinPartitions("tb", "mode", "token", "id")
        rows.write.partitionBy("tb").parquet(self._path(name, "postings"), compression=COMPRESSION)
        self._write_dictionary(name, self._read(name, "postings", f"{POSTING}, tb int"), of)
        self._summed(last).sortWithinPartitions("mode", "token").write.parquet(self._path(name, "statistics"))
        if not self._publish({**last, "parts": [{"folder": name, "touched": 0}]}, last):
            self.files.delete(name)

    def _summed(self, manifest: dict) -> DataFrame:
        parts = [self._read(p["folder"], "statistics", "mode string, field string, token string, df long") for p in manifest["parts"]]
        every = reduce(DataFrame.unionAll, parts)
        if len(parts) == 1:
            return every
        return every.groupBy("mode", "field", "token").agg(F.sum("df").alias("df")).where("df <> 0")

    def _ready(self) -> dict:
        found = self.manifest()
        if found is None:
            raise ValueError("the table has no keyword index yet; refresh it first")
        return found

    @property
    def documents(self) -> int:
        """How many documents the index holds."""
        return self._ready()["documents"]

    def read(self) -> DataFrame:
        """The documents that the index is about, which later commits may have changed."""
        state = loaded(self._ready()["state"])
        return self.table._merged(state).select(*self.table.spec.schema.fieldNames())

    def term_statistics(self, mode: str = WORD) -> DataFrame:
        """Document frequency of every token of every field: ``field, token, df``; whole-word and exact mode."""
        if mode == SUBSTRING:
            raise ValueError("terms of substring mode are no tokens of the index")
        return self._summed(self._ready()).where(F.col("mode") == mode).select("field", "token", "df")

    def postings(self, tokens: DataFrame, modes: Sequence[str]) -> DataFrame:
        """``mode, q, id, field, freq, norm`` for every query token (``mode, q``) found in a field."""
        manifest = self._ready()

        def wanted(mode: str) -> DataFrame:
            return tokens.where(F.col("mode") == mode).select("q").distinct()

        def rows(mode: str, asked: DataFrame, column: str) -> DataFrame:
            """The postings of the buckets in which asked tokens lie: at most as many numbers as there are buckets."""
            buckets = sorted(r[0] for r in asked.select(_bucket(column, manifest["buckets"])).distinct().collect())
            return self._whole(manifest, buckets).where(F.col("mode") == mode).drop("mode", "tb")

        found = []
        if SUBSTRING in modes:
            held = written_once(self._holding(manifest, wanted(SUBSTRING)), "words")
            met = hot_join(rows(SUBSTRING, held, "token"), held, ["token"], ["id"], is_small(held))
            found.append(_posted(met, SUBSTRING, "sum(freq * times)"))
        if WORD in modes:
            single = wanted(WORD).where(~F.col("q").contains(text.SEPARATOR)).withColumn("token", F.col("q"))
            met = hot_join(rows(WORD, single, "token"), single, ["token"], ["id"], is_small(single))
            found.append(_posted(met, WORD, "sum(freq)"))
        if PHRASE in modes:
            found.append(self._phrases(wanted(WORD), rows))
        if EXACT in modes:
            values = wanted(EXACT).withColumn("token", F.col("q"))
            met = hot_join(rows(EXACT, values, "token"), values, ["token"], ["id"], is_small(values))
            found.append(_posted(met, EXACT, "sum(freq)"))
        return reduce(DataFrame.unionByName, found)

    def _holding(self, manifest: dict, wanted: DataFrame) -> DataFrame:
        """(q, token, times): the words that hold a term, found through the term's first gram."""
        asked = wanted.where(F.length("q") >= GRAMS[0]).withColumn("gram", F.substring("q", 1, GRAMS[-1]))
        buckets = sorted(r[0] for r in asked.select(_bucket("gram", manifest["buckets"])).distinct().collect())
        parts = [self._read(p["folder"], "dictionary", "gram string, word string, gb int") for p in manifest["parts"]]
        grams = reduce(DataFrame.unionAll, parts).where(F.col("gb").isin(buckets)).drop("gb")
        grams = grams.distinct() if len(parts) > 1 else grams
        met = hot_join(grams, asked, ["gram"], ["word"], is_small(asked)).where(F.col("word").contains(F.col("q")) | _odd("word"))
        forms = met.select("q", F.col("word").alias("token"), F.expr(f"explode({text.delimited_tokens('word')})").alias("form"))
        counted = forms.select("q", "token", _times(F.col("form"), F.col("q")).alias("times"))
        return counted.groupBy("q", "token").agg(F.sum("times").alias("times")).where("times > 0")

    def _phrases(self, wanted: DataFrame, rows) -> DataFrame:
        """A start position counts when all words of the phrase are at their places after it."""
        mark = text.literal(text.SEPARATOR)
        words = wanted.where(F.col("q").contains(text.SEPARATOR)).selectExpr(
            "q", f"posexplode(split(q, {mark})) AS (at, token)",
            f"size(filter(split(q, {mark}), w -> w <> {text.literal(text.STOPPED)})) AS words",
        ).where(F.col("token") != text.STOPPED)
        met = hot_join(rows(WORD, words, "token"), words, ["token"], ["id"], is_small(words))
        starts = (
            met.select("q", "id", "field", "norm", "words", "at", F.explode("places").alias("place"))
            .groupBy("q", "id", "field", "place.item", (F.col("place.spot") - F.col("at")).alias("start"))
            .agg(F.count(F.lit(1)).alias("found"), F.min("words").alias("words"), F.min("norm").alias("norm"))
            .where("found = words")
        )
        return _posted(starts, WORD, "count(1)")


def _odd(column: str) -> Column:
    """Whether a word has marks, so that its joined parts may hold what itself does not."""
    return F.col(column).rlike(text.MARK)
