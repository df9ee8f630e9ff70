"""DuckDB SQL for the operators that SQL can express; each follows the definition, not the method."""

from __future__ import annotations

from netsight.llm import sharding

_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """CRC-32 of a text column, with ``crc_table`` joined."""
    digit = lambda i: f"(strpos('0123456789ABCDEF', b[{i}]) - 1)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: {digit(1)} * 16 + {digit(2)})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def _mixed(h: str) -> str:
    """``sharding.mixed32``; the last turn has no product."""
    turns = ", ".join(map(str, range(1, sharding.ROUNDS + 2)))
    return (f"list_reduce(list_prepend(({h})::BIGINT, [{turns}]), lambda a, k: CASE WHEN k > {sharding.ROUNDS} THEN xor(a, a >> 16) "
            f"ELSE (xor(a, a >> 16) * {sharding.FACTOR}) & {sharding.MASK} END)")


def _winner(shards: int) -> str:
    bids = f"SELECT i, -1 / ln(({_mixed('xor(hash, seed)')} + 0.5) / 4294967296.0) AS bid FROM seeds WHERE i < {shards}"
    return f"(SELECT i FROM ({bids}) ORDER BY bid DESC, i LIMIT 1)::INTEGER"


_COVER_TREE = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5"""

_LEAF = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(octet_length(encode({t}))::VARCHAR || ':' || {t}, '-')"


def _tree(name: str, nodes: str) -> str:
    """CTEs for trees of three over ``nodes`` (tree, place, digest): (tree, step, place, digest, n) of all nodes."""
    return f"""{name} AS (
  SELECT tree, 0 AS step, place, digest, n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes})
  UNION ALL
  SELECT tree, step + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, step, place // 3)"""


def _path(name: str, nodes: str, tree: str) -> str:
    """CTEs: for each leaf of ``nodes`` and step, the siblings left and right."""
    return f"""{name} AS (
  SELECT l.tree, l.place AS leaf, s.step,
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < l.place // power(3, s.step)::BIGINT), '') AS a,
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > l.place // power(3, s.step)::BIGINT), '') AS b
  FROM {nodes} l JOIN {tree} s ON l.tree = s.tree AND s.n > 1 AND s.place // 3 = l.place // power(3, s.step + 1)::BIGINT
  GROUP BY l.tree, l.place, s.step)"""


_MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF} || {_TEXT.format(t='text')}) AS digest,
         CASE WHEN {_crc('doc_id::VARCHAR')} % 2 = 0 THEN sha256({_LEAF} || {_TEXT.format(t="replace(text, chr(10), '')")}) END AS forged
  FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM docs),
{_tree('nodes', 'leaves')},
subroots AS (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE n = 1),
{_tree('tops', 'subroots')},
{_path('low', 'leaves', 'nodes')},
{_path('high', 'subroots', 'tops')},
paths AS (
  SELECT l.doc_id, l.digest, l.forged, s.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
         list_concat(coalesce((SELECT list({{'a': a, 'b': b}} ORDER BY step) FROM low WHERE low.tree = l.tree AND low.leaf = l.place), []),
                     coalesce((SELECT list({{'a': a, 'b': b}} ORDER BY step) FROM high WHERE high.leaf = s.place), [])) AS path
  FROM leaves l JOIN subroots s ON s.name = l.tree)
SELECT doc_id, digest AS leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda p: p.a || p.b), 'string_agg', ''), '')) AS proof_sha256,
       folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_prepend({{'a': coalesce(forged, digest), 'b': ''}}, path), lambda c, p: {{'a': sha256(p.a || c.a || p.b), 'b': ''}}).a AS folded FROM paths)"""

_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
words AS (SELECT lang, id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split),
total AS (SELECT lang, count(*)::BIGINT AS n FROM words GROUP BY lang),
next AS (SELECT lang, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY id ORDER BY pos)),
grams AS (
  SELECT lang, 1 AS k, word AS phrase FROM next
  UNION ALL SELECT lang, 2, word || ' ' || w2 FROM next WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, word || ' ' || w2 || ' ' || w3 FROM next WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, word || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM next WHERE w4 IS NOT NULL),
counts AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.w, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM (SELECT found.*, j FROM found, range(1, 4) r(j) WHERE j < k) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM found, range(2, 4) r(m), range(1, 4) s(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase)
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed JOIN total USING (lang) WHERE rank <= 2000"""

_SHARDS = f"""
WITH {_CRC_TABLE},
seeds AS (SELECT i, {_mixed('i + 1')} AS seed FROM range({sharding.SHARDS + 1}) r(i)),
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, {_crc("coalesce(text, '')")} AS text_crc32,
         {_mixed(f"xor({_mixed(f'doc_id & {sharding.MASK}')}, doc_id >> 32)")} AS hash
  FROM documents, crc_table),
dealt AS (SELECT *, {_winner(sharding.SHARDS)} AS shard, {_winner(sharding.SHARDS + 1)} AS grown_shard FROM docs)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM dealt"""


def llm_sql() -> dict[str, str]:
    return {"op4_dual_cover_tree": _COVER_TREE, "op11_veb_merkle": _MERKLE, "op12_misra_gries": _COLLOCATIONS, "op13_rendezvous": _SHARDS}
