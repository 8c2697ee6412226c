"""Byte-level BPE encoding and decoding by recursive queries, one DuckDB database per task.

Texts are cut into words by the vocabulary's pattern. Every word that a task has not met before
becomes rows of (word, position, token id), at first one row per byte; one that is a token itself needs no step. A recursive query
joins neighbouring rows with the merge table and contracts, in each word and step, the leftmost pair
of least rank, until no row has a partner. An aggregation in the order of positions
spells each word as ids and, by the vocabulary, as decoded bytes; what the words of a text are spelled as, in the
order of their places, is one run of bytes and its result.

The merge table holds one pair per token: the last two parts of the token when its own bytes are
merged by rank. No other pair of these bytes can meet in any text. If each rank is above those of the
pair's parts, as in any trained vocabulary, contracting a pair creates no pair of lower rank;
long words then contract all disjoint occurrences of their least pair in one step, with the same result. For
a vocabulary without that property they too go one pair at a time.

A task remembers the words it has met, up to ``REMEMBERED``, and takes texts in portions of
``PORTION`` words; a text of any length is digested portion by portion.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import query, table

#: Words that one task remembers; beyond, it forgets all and starts again.
REMEMBERED = 1_500_000

#: Words of texts that one query takes, and those of them whose merges one recursion takes.
PORTION = 400_000
AT_ONCE = 50_000

#: Bytes from which a word contracts all its least pairs in one step and keeps only its present rows.
LONG = 64

#: DuckDB's limit for one task.
MEMORY = "400MB"

Batches = Iterator[pa.RecordBatch]

_TABLES = """
    CREATE TABLE spelled (word INTEGER, ids BLOB, bytes BLOB);
    CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows;
    CREATE TABLE merges AS SELECT * FROM merge_rows"""

# A row holds the token, the one after it and the rank of both together, so that a step looks up only what a
# contraction changed. The least pair of a word is one number: rank, position, next position. All steps are
# kept until the end, which short words can afford; a word's last step is its result.
_MERGE_SHORT = f"""
    WITH RECURSIVE state(step, word, pos, next_pos, id, next_id, merged) AS (
        SELECT 0, word, pos, pos + 1, s.id, s.next_id, m.merged
        FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id FROM symbols) s
        LEFT JOIN merges m ON s.id = m.first AND s.next_id = m.second
        UNION ALL
        (WITH least AS (
            SELECT word, min((merged::BIGINT * {LONG} + pos) * {2 * LONG} + next_pos) AS pair FROM state GROUP BY word),
        pair AS (
            SELECT word, pair // {2 * LONG * LONG} AS merged, pair // {2 * LONG} % {LONG} AS pos, pair % {2 * LONG} AS next_pos
            FROM least WHERE pair IS NOT NULL),
        around AS (
            SELECT word, p.merged, p.pos, p.next_pos, max(CASE WHEN s.next_pos = p.pos THEN s.id END) AS before_id,
                   max(CASE WHEN s.pos = p.next_pos THEN s.next_pos END) AS end_pos,
                   max(CASE WHEN s.pos = p.next_pos THEN s.next_id END) AS after_id
            FROM state s JOIN pair p USING (word) WHERE s.next_pos = p.pos OR s.pos = p.next_pos GROUP BY ALL),
        known AS (
            SELECT a.*, b.merged AS with_before, c.merged AS with_after FROM around a
            LEFT JOIN merges b ON a.before_id = b.first AND a.merged = b.second
            LEFT JOIN merges c ON a.merged = c.first AND a.after_id = c.second)
        SELECT step + 1, s.word, s.pos,
               CASE WHEN s.pos = k.pos THEN k.end_pos ELSE s.next_pos END,
               CASE WHEN s.pos = k.pos THEN k.merged ELSE s.id END,
               CASE WHEN s.pos = k.pos THEN k.after_id WHEN s.next_pos = k.pos THEN k.merged ELSE s.next_id END,
               CASE WHEN s.pos = k.pos THEN k.with_after WHEN s.next_pos = k.pos THEN k.with_before ELSE s.merged END
        FROM state s JOIN known k ON s.word = k.word WHERE s.pos <> k.next_pos)),
    steps AS (SELECT word, max(step) AS step FROM state GROUP BY word),
    result AS (SELECT word, pos, id FROM state SEMI JOIN steps USING (word, step))"""

# Only the present row of each position is kept; a position that was merged into another has no id.
_MERGE_LONG = """
    WITH RECURSIVE state(word, pos, id) USING KEY (word, pos) AS (
        SELECT word, pos, id FROM symbols
        UNION ALL
        (WITH live AS (
            SELECT word, pos, id FROM recurring.state WHERE id IS NOT NULL AND word IN (SELECT word FROM state)),
        pairs AS (
            SELECT word, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos, row_number() OVER w AS nth
            FROM live WINDOW w AS (PARTITION BY word ORDER BY pos)),
        ranked AS (
            SELECT p.word, p.pos, p.next_pos, p.nth, m.merged,
                   min(m.merged) OVER (PARTITION BY p.word) AS least
            FROM pairs p JOIN merges m ON p.id = m.first AND p.next_id = m.second),
        hits AS (
            SELECT *, nth - row_number() OVER (PARTITION BY word ORDER BY nth) AS run FROM ranked WHERE merged = least),
        -- Pairs overlap only in runs of one symbol: there every second one counts.
        chosen AS (
            SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY nth) AS in_run,
                   row_number() OVER (PARTITION BY word ORDER BY nth) AS in_word FROM hits)
        SELECT word, unnest([pos, next_pos]), unnest([merged, NULL]) FROM chosen WHERE {which})),
    result AS (SELECT word, pos, id FROM state WHERE id IS NOT NULL)"""

_SPELL = """
    INSERT INTO spelled {merged}
    SELECT word, unhex(string_agg(v.id_hex, '' ORDER BY pos)), unhex(string_agg(v.bytes_hex, '' ORDER BY pos))
    FROM result JOIN vocabulary v USING (id) GROUP BY word"""

_SPELL_TOKENS = "INSERT INTO spelled SELECT word, unhex(id_hex), unhex(bytes_hex) FROM symbols JOIN vocabulary USING (id)"

_TEXTS = "SELECT ids, bytes FROM places JOIN spelled USING (word) ORDER BY place"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the token's bytes end in before the last merge; None if they never become the token."""
    parts = [token[i: i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return None
        i = min(found)[1]
        parts[i: i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class Merger:
    """A rank file as tables of a DuckDB database, with the words that are spelled already."""

    def __init__(self, path: str, pattern: str, memory: str = MEMORY) -> None:
        self.ranks = ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [(ranks[p[0]], ranks[p[1]], r) for t, r in ranks.items() if len(t) > 1 and (p := last_pair(t, ranks))]
        single = set(self.of_byte.tolist())
        rising = all(part in single or part < rank for *parts, rank in rows for part in parts)
        self.merge_long = _MERGE_LONG.format(which="in_run % 2 = 1" if rising else "in_word = 1")
        columns = [pa.array(c, pa.int32()) for c in zip(*rows)] or [pa.array([], pa.int32())] * 3
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False})
        self.base.register("merge_rows", pa.table(columns, names=["first", "second", "merged"]))
        self.base.register("vocabulary_rows", pa.table({
            "id": pa.array(ranks.values(), pa.int32()),
            "id_hex": [r.to_bytes(4, "little").hex() for r in ranks.values()],
            "bytes_hex": [t.hex() for t in ranks],
        }))
        self.base.execute(_TABLES)
        self.codes: dict[str, int] = {}

    def _with(self, name: str, rows: pa.Table, statement: str) -> pa.Table:
        self.base.register(name, rows)
        try:
            return self.base.sql(statement).to_arrow_table() if statement.startswith("SELECT") else self.base.execute(statement).fetchall()
        finally:
            self.base.unregister(name)

    def _spell(self, words: list[str], merge: str) -> None:
        coded = [w.encode() for w in words]
        sizes = np.array([len(c) for c in coded])
        symbols = pa.table({
            "word": np.repeat(np.array([self.codes[w] for w in words], np.int32), sizes),
            "pos": (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
            "id": self.of_byte[np.frombuffer(b"".join(coded), np.uint8)],
        })
        self._with("symbols", symbols, _SPELL.format(merged=merge))

    def learn(self, words: list[str]) -> None:
        """Spell the words that are not spelled yet; forget all others first if they are too many."""
        new = list(set(words).difference(self.codes))
        if len(self.codes) + len(new) > REMEMBERED:
            self.codes, new = {}, list(set(words))
            self.base.execute("DELETE FROM spelled")
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
        tokens, short, long = [], [], []
        for word in new:
            coded = word.encode()
            if coded in self.ranks:
                tokens.append((self.codes[word], self.ranks[coded]))
            else:
                (short if len(coded) <= LONG else long).append(word)
        # A word that is a token is spelled already.
        columns = [pa.array(c, pa.int32()) for c in zip(*tokens)] or [pa.array([], pa.int32())] * 2
        self._with("symbols", pa.table(columns, names=["word", "id"]), _SPELL_TOKENS)
        for i in range(0, len(short), AT_ONCE):
            self._spell(short[i: i + AT_ONCE], _MERGE_SHORT)
        for word in long:
            self._spell([word], self.merge_long)

    def portions(self, texts: list[str]) -> Iterator[list[tuple[int, list[str], bool]]]:
        """Texts as (number, words, whether the text ends there), in lists of at most ``PORTION`` words."""
        held: list[tuple[int, list[str], bool]] = []
        size = 0
        for i, text in enumerate(texts):
            words = (m[0] for m in self.pattern.finditer(text)) if len(text) > PORTION else iter(self.pattern.findall(text))
            last = False
            while not last:
                part = list(islice(words, PORTION - size))
                size += len(part)
                last = size < PORTION
                held.append((i, part, last))
                if not last:
                    yield held
                    held, size = [], 0
        yield held

    def results(self, texts: list[str], full: bool = False) -> list[tuple[int, str, str, list[int] | None, bytes | None]]:
        """Number of tokens, the digests of ids and of decoded bytes, and with ``full`` both themselves, of each text."""
        counts = [0] * len(texts)
        digests = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        kept: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in texts]
        for portion in self.portions(texts):
            words = [w for _, some, _ in portion for w in some]
            self.learn(words)
            places = pa.table({
                "place": np.arange(len(words), dtype=np.int32),
                "word": np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)),
            })
            runs = [_run(column) for column in self._with("places", places, _TEXTS).columns]
            first = 0
            for i, some, _ in portion:
                last = first + len(some)
                for which, (offsets, values) in enumerate(runs):
                    value = values[offsets[first]: offsets[last]]
                    digests[i][which].update(value)
                    counts[i] += len(value) // 4 if which == 0 else 0
                    if full:
                        kept[i][which].append(bytes(value))
                first = last
        return [
            (n, a.hexdigest(), b.hexdigest(), *((np.frombuffer(b"".join(x), "<u4").tolist(), b"".join(y)) if full else (None, None)))
            for n, (a, b), (x, y) in zip(counts, digests, kept)
        ]


def _run(column: pa.ChunkedArray) -> tuple[np.ndarray, memoryview]:
    """Where each value starts and the last one ends in the bytes of all values."""
    values = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks] or [pa.array([], pa.large_binary())])
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(1, np.int64), memoryview(b"")
    return np.frombuffer(offsets, np.int64)[: len(values) + 1], memoryview(data)


_mergers: dict[tuple[str, str], Merger] = {}


def _merger(path: str, pattern: str) -> Merger:
    if (path, pattern) not in _mergers:
        _mergers[path, pattern] = Merger(path, pattern)
    return _mergers[path, pattern]


def _encoder(path: str, pattern: str, full: bool) -> Callable[[Batches], Batches]:
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if full else []

    def run(batches: Batches) -> Batches:
        merger = _merger(path, pattern)
        for batch in batches:
            results = merger.results([t or "" for t in batch.column("text").to_pylist()], full)
            columns = [pa.array([r[i] for r in results], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *(name for name, _ in fields)])

    return run


def encode_decode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", full: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_tokens, ids_sha256, decoded_sha256``.

    With ``full`` also ``ids`` and ``decoded`` (bytes). The digests are of the ids as little-endian
    unsigned 32-bit integers and of the decoded bytes. ``path`` names a rank file that every worker can read and
    ``pattern`` cuts texts into words; no special tokens. Null and empty texts have no ids and decode to
    nothing. Repeated rows each have their result. Texts and words of any length are read whole. An empty
    table gives an empty table; other columns are not read.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    result = f"id {given.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    result += ", ids array<int>, decoded binary" if full else ""
    return given.mapInArrow(_encoder(path, pattern, full), result)


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
