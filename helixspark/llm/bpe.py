"""Byte-level BPE encoding and decoding as DuckDB recursive queries inside each task; token counts from the same pieces."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from helixspark.llm._common import id_text, pieces, table, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Rounds of one recursive query, bytes of pieces in one, tokens in one decoding query; bytes from which a piece counts as long
#: (a choice of query that doesn't change results).
ROUNDS, PIECE_BYTES, DECODE_TOKENS, LONG = 48, 250_000, 250_000, 40
#: Bytes of pieces with their ids that a worker remembers, an entry's own bytes, characters of texts at once.
REMEMBERED, ENTRY, BATCH_CHARS = 64 << 20, 250, 500_000
#: Chunks end where a piece always does: before a space between words and around white space. ``re`` counts the four separators
#: U+001C to U+001F as white space, the pattern does not: texts with these can't be cut so.
CHUNKS, SEPARATORS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall, re.compile("[\x1c-\x1f]")

# A state holds a row for each token of each piece, linked to the token after it. One round joins the neighbouring pairs
# with the merge table, finds each piece's leftmost pair of least rank and contracts it. A piece without a pair has reached
# its fixpoint and stays behind in the state of its last round.
CONTRACT = """
with recursive state(round, piece, place, token, follows) as (
    select 0, piece, place, token, follows from tokens
  union all
    select s.round + 1, s.piece, s.place,
           case when s.place = b.at then b.merged else s.token end,
           case when s.place = b.at then b.beyond else s.follows end
    from state s join (
        select piece, min(key) & 4294967295 as at, (min(key) >> 32)::int as merged, arg_min(gone, key) as gone, arg_min(beyond, key) as beyond
        from (
            select s.piece, (m.merged::bigint << 32) | s.place as key, t.place as gone, t.follows as beyond
            from state s join state t on s.follows = t.place join merges m on s.token = m.first and t.token = m.second
        ) group by piece
    ) b on s.piece = b.piece
    where s.place <> b.gone
)
select s.round, s.piece, s.place, s.token
from state s join (select piece, max(round) as round from state group by piece) f on s.piece = f.piece and s.round = f.round
"""
# For long pieces one round contracts, besides the leftmost pair of least rank, its later occurrences that do not overlap,
# unless the merged token could form a pair of lower rank (``alone``), for then the order matters. So a run of one letter
# takes a round for each doubling, not for each letter.
CONTRACT_RUNS = """
with recursive state(round, piece, place, token) as (
    select 0, piece, place, token from tokens
  union all
    select round + 1, piece, place, case when taken then merged else token end
    from (
        select *, coalesce(lag(taken) over w, false) as gone
        from (
            select *, best and (nth = 1 or not alone and (not twin or run % 2 = 1)) as taken
            from (
                select *, row_number() over (partition by piece, best order by place) as nth,
                       case when twin then row_number() over (partition by piece, best, strip order by place) else 1 end as run
                from (
                    select *, case when twin then place_no - row_number() over (partition by piece, best order by place) else 0 end as strip
                    from (
                        select *, merged is not null and merged = least_rank as best, token = next_token as twin
                        from (
                            select s.round, s.piece, s.place, s.token, s.next_token, s.place_no, m.merged, m.alone,
                                   min(m.merged) over (partition by s.piece) as least_rank
                            from (
                                select *, lead(token) over p as next_token, row_number() over p as place_no
                                from state where round < {rounds}
                                window p as (partition by piece order by place)
                            ) s left join merges m on s.token = m.first and s.next_token = m.second
                        ) where least_rank is not null
                    )
                )
            )
        ) window w as (partition by piece order by place)
    ) where not gone
)
select s.round, s.piece, s.place, s.token
from state s join (select piece, max(round) as round from state group by piece) f on s.piece = f.piece and s.round = f.round
"""
DECODE = """
select run, string_agg(v.bytes, '' order by place) as text
from ids join vocabulary v on ids.id = v.id group by run
"""


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One worker's DuckDB with the merge table and the vocabulary; remembers the pieces it has met."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        known = ranks(path)
        first, second, merged, lower = [], [], [], {}
        for token, rank in known.items():
            for k in range(1, len(token)):
                if (a := known.get(token[:k])) is not None and (b := known.get(token[k:])) is not None:
                    first.append(a)
                    second.append(b)
                    merged.append(rank)
                    for part in (a, b):
                        lower[part] = min(lower.get(part, rank), rank)
        alone = [lower.get(r, r) < r for r in merged]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False})
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        self.db.register("t_merges", pa.table([pa.array(x, k) for x, k in zip((first, second, merged, alone), kinds, strict=True)], ["first", "second", "merged", "alone"]))
        self.db.register("t_vocabulary", pa.table({"id": pa.array(known.values(), pa.uint32()), "bytes": [x.decode("latin-1") for x in known]}))
        self.db.execute("create table merges as from t_merges; create table vocabulary as from t_vocabulary")
        self.single = np.zeros(256, np.int32)
        for b in range(256):
            self.single[b] = known[bytes([b])]
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def fixpoint(self, found: list[bytes]) -> list[bytes]:
        """Token ids of each piece (bytes, none empty; either all long or all short)."""
        query = (CONTRACT_RUNS if len(found[0]) >= LONG else CONTRACT).format(rounds=ROUNDS)
        lengths = np.array([len(x) for x in found])
        piece = np.repeat(np.arange(len(found), dtype=np.int32), lengths)
        place = np.arange(len(piece), dtype=np.int32)
        token = self.single[np.frombuffer(b"".join(found), np.uint8)]
        out = [b""] * len(found)
        while len(piece):
            follows = np.where(np.append(piece[1:] == piece[:-1], False), np.append(place[1:], 0), -1)
            self.db.register("tokens", pa.table({"piece": piece, "place": place, "token": token, "follows": follows.astype(np.int32)}))
            got = self.db.sql(query).to_arrow_table()
            order = np.argsort(got.column(2).to_numpy(), kind="stable")
            r, piece, place, token = (got.column(k).to_numpy()[order] for k in range(4))
            ended = r < ROUNDS if query != CONTRACT else r >= 0
            ids, starts = np.unique(piece[ended], return_index=True)
            raw, cuts = token[ended].astype("<u4").tobytes(), [*(starts * 4).tolist(), 4 * int(ended.sum())]
            for p, a, b in zip(ids.tolist(), cuts, cuts[1:], strict=False):
                out[p] = raw[a:b]
            piece, place, token = piece[~ended], place[~ended], token[~ended]
        return out

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Each text's ids as little-endian unsigned 32-bit integers, a bytes object for each of its pieces.

        Half of what is remembered goes at a time, the pieces that no text had since the last time: rare ones, of which most texts
        are the only one, don't drive out the frequent ones.
        """
        cuts, flat = [0], []
        for x in texts:
            flat += self.split(x)
            cuts.append(len(flat))
        if self.held > REMEMBERED // 2:
            self.older, self.memory, self.held = self.memory, {}, 0
        found = list(map(self.memory.get, flat))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = {flat[i] for i in missing}
        known = {p: ids for p in fresh if (ids := self.older.get(p)) is not None}
        new = {p: p.encode() for p in fresh if p not in known}
        for long in (False, True):
            some = [p for p, raw in new.items() if (len(raw) >= LONG) == long]
            for a, b in pieces((len(new[p]) for p in some), PIECE_BYTES):
                known.update(zip(some[a:b], self.fixpoint([new[p] for p in some[a:b]]), strict=True))
        self.memory.update(known)
        self.held += sum(ENTRY + 2 * len(x) for x in known)
        for i in missing:
            found[i] = known[flat[i]]
        return [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """The bytes of each text, given as ids: rows of tokens join the vocabulary, an ordered aggregation puts them together."""
        out = [b""] * len(texts)
        for a, b in pieces(map(len, texts), DECODE_TOKENS):
            some = texts[a:b]
            flat = np.concatenate(some)
            run = np.repeat(np.arange(a, b, dtype=np.int32), list(map(len, some)))
            self.db.register("ids", pa.table({"run": run, "place": np.arange(len(flat), dtype=np.int32), "id": flat}))
            got = self.db.sql(DECODE).to_arrow_table()
            for r, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                out[r] = text.encode("latin-1")
        return out


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def forget() -> None:
    codec.cache_clear()
    ranks.cache_clear()


def vocabulary(path: str | None) -> tuple[str, str]:
    """The rank file, by default the public one, and the pattern that cuts texts before merging."""
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """A row per input row: token count and digests, and of ``keep`` the ids and the text decoded from them.

    A null text counts as empty and has no tokens; a null id stays null; repeated rows give repeated results; a text of any
    length is encoded whole. An empty table gives none. The result is that of the tiktoken library's ``encode_ordinary``.
    """
    more = {"ids": "array<bigint>", "decoded": "binary"}
    kinds = {"ids": pa.list_(pa.int64()), "decoded": pa.binary()}
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {more[k]}" for k in keep)
    path, pattern = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            sizes = [x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()]
            for a, b in pieces(sizes, BATCH_CHARS):
                runs = c.encode([x or "" for x in batch.column(1)[a:b].to_pylist()])
                ids = [b"".join(x) for x in runs]
                back = c.decode([np.frombuffer(x, "<u4") for x in ids])
                columns = [batch.column(0)[a:b], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                extra = {"ids": (np.frombuffer(x, "<u4").astype(np.int64) for x in ids), "decoded": back}
                yield pa.RecordBatch.from_arrays(columns + [pa.array(list(extra[k]), kinds[k]) for k in keep], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run, "bpe", forget), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), keep=())


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}
