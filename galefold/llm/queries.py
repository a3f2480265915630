"""Queries of this subpackage for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontamination, licenses, media, packing, quality, secrets, sharding, simhash, substrings, token_files, vafile
from .common import table


def _on_documents(f: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": _on_documents(token_files.op1),
        "op2_simhash": _on_documents(simhash.op2),
        "op3_label_propagation": _on_documents(sharding.op3),
        "op4_secret_scan": secrets.op4,
        "op5_decontamination": decontamination.op5,
        "op6_substrings": _on_documents(substrings.op6),
        "op7_license_templates": _on_documents(licenses.op7),
        "op8_media_sequences": _on_documents(media.op8),
        "op10_quality": quality.op10,
        "op9_best_fit_packing": _on_documents(packing.op9),
        "op11_collocations": _on_documents(collocations.op11),
        "op12_chat": lambda spark, sf_dir: chat.op12(spark, table(spark, sf_dir, "conversations")),
        "op13_va_file": lambda spark, sf_dir: vafile.op13(spark, table(spark, sf_dir, "embeddings")),
    }


#: Windows of 20 words as strings; every later start of one is a repeat, and its words go.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, p, string_agg(word, ' ') OVER run AS t, count(*) OVER run AS n FROM x WINDOW run AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS place FROM k WHERE n = 20),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r WHERE place > 1),
y AS (SELECT x.doc_id, x.p, x.word, c.p IS NOT NULL AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""


#: Phrases as strings, counted by grouping; integers beyond 64 bits where products need them.
OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3), (4)) AS z(size) WHERE i + size - 1 <= len(w)),
total AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
cut AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k + 1 : len(k.w)], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM c, (VALUES (2), (3)) AS z(m), (VALUES (1), (2), (3)) AS y(i) WHERE m < len(w) AND i + m - 1 <= len(w) GROUP BY ALL),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank FROM best LEFT JOIN inside USING (lang, phrase) WHERE NOT coalesce(100::HUGEINT * most >= 80::HUGEINT * a, false))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


_MEDIA = r"""!\[[^\]\n]*\]\([^()\s]+[^()\n]*\)|<audio src="[^"\n]*"[^<>\n]*>|<document src="[^"\n]*"[^<>\n]*>"""
_CONTROL = r"""\\|</?s>|\[/?INST\]|\[/?SYS\]|\[/?ROLE\]|\[:\]|\[IMG\]|\[AUD\]|\[DOC\]"""
#: Turns as given; the formatted length is that of the text, with a character for each escape, five for each medium, and what marks the turn.
OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, len(regexp_extract_all(text, '{_MEDIA}')) AS n_media, regexp_replace(text, '{_MEDIA}', chr(10), 'g') AS plain FROM c),
t AS (SELECT *, length(plain) + len(regexp_extract_all(plain, '{_CONTROL}')) + 4 * n_media + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 15 WHEN 'system' THEN 13 ELSE 19 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars, sum(n_media)::BIGINT AS n_attachments FROM t GROUP BY conv_id
"""


def _op13_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Rounds one after the other: distances by lists, sums by dimension."""
    out = [f"WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(1024 * x)::BIGINT for x in embedding::DOUBLE[]] AS y FROM embeddings WHERE len(embedding) = {dims} AND len([x for x in embedding::DOUBLE[] if x IS NOT NULL AND isfinite(x)]) = {dims})",
           f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), y) - 1 AS cluster, y AS q FROM v QUALIFY cluster < {k})"]
    for r in range(rounds + 1):
        far = f"list_sum([(y[i] - q[i]) * (y[i] - q[i]) for i in range(1, {dims + 1})])"
        out.append(f"a{r} AS MATERIALIZED (SELECT row, vec_id, y, arg_min(cluster, (d, cluster)) AS cluster, min(d)::BIGINT AS distance FROM (SELECT row, vec_id, y, cluster, {far} AS d FROM v, c{r}) GROUP BY row, vec_id, y)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT cluster, i, sum(y[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) AS z(i) GROUP BY cluster, i)")
            out.append(f"n{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY cluster)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n{r}.q, c.q) AS q FROM c{r} c LEFT JOIN n{r} USING (cluster))")
    last = f"SELECT vec_id, a.cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"
    return ",\n".join(out) + "\n" + last


def oracle_sql() -> dict[str, str]:
    """Of the others, tokenizers, XXH64, fitted models, PNG and automata are beyond SQL; tests compare them with plain versions."""
    return {"op6_substrings": OP6_SQL, "op11_collocations": OP11_SQL, "op12_chat": OP12_SQL, "op13_va_file": _op13_sql()}
