"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from loomnote.llm.common import documents

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_source_mixing(spark, sf_dir):
    from loomnote.llm.mixing import mix

    return mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "copies", "taken")


@_query
def op2_chosen_path_dedup(spark, sf_dir):
    from loomnote.llm.chosen_path import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=2, least=80).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, counted; reachability by recursion.
ORACLES["op2_chosen_path_dedup"] = (
    f"WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), "
    "sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS s FROM w), "
    "sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1), "
    "common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2), "
    "links AS (SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)), "
    "ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), "
    "reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN ways ON x = r.other) "
    "SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"
)


@_query
def op3_matroska(spark, sf_dir):
    from loomnote.llm.matroska import text_media

    return text_media(documents(spark, sf_dir))


@_query
def op4_winnowing(spark, sf_dir):
    from loomnote.llm.winnowing import compare_edited

    return compare_edited(documents(spark, sf_dir), k=5, w=8)


@_query
def op5_quotation_linking(spark, sf_dir):
    from loomnote.llm.quotations import link

    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"), whole=True)


def toxicity_chain(spark, docs, sf_dir):
    """The chain fitted on ``labels``: poor quality first, then toxicity."""
    from loomnote.llm.toxicity import train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    return train(docs, labels, ("low_quality", "toxic"))


@_query
def op6_classifier_chain(spark, sf_dir):
    from loomnote.llm.toxicity import score

    docs = documents(spark, sf_dir)
    return score(docs, toxicity_chain(spark, docs, sf_dir)).selectExpr("doc_id", "p_low_quality", "p_toxic", "p_toxic >= 0.5 AS is_toxic")


@_query
def op7_best_fit_packing(spark, sf_dir):
    from loomnote.llm.packing import pack

    return pack(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), size=1024, end_id=0)


@_query
def op8_katz_scores(spark, sf_dir):
    from loomnote.llm.katz import score

    return score(documents(spark, sf_dir))


@_query
def op9_license_scan(spark, sf_dir):
    from loomnote.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def _license_sql() -> str:
    from loomnote.llm import licenses as L

    words = lambda text: f"regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quoted = lambda text: text.lower().replace("'", "''")
    templates = ", ".join(f"({i}, '{label}', '{quoted(text)}')" for i, (label, text) in enumerate(L.TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM places WHERE " + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split())) for phrase, label in L.PHRASES.items()
    )
    gram = " || ' ' || ".join(f"ws[i + {j}]" for j in range(L.K))
    return (
        f"WITH w AS (SELECT doc_id, {words(_LOWER)} AS ws FROM documents), places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), "
        f"base AS ({phrases}), t AS (SELECT id, label, {words('text')} AS ws FROM (VALUES {templates}) v(id, label, text)), "
        f"tg AS (SELECT id, label, len(ws) AS size, i - 1 AS place, {gram} AS g FROM (SELECT *, unnest(range(1, len(ws) - {L.K - 2})) AS i FROM t)), "
        f"dg AS (SELECT doc_id, i - 1 AS pos, {gram} AS g FROM places WHERE i + {L.K - 1} <= len(ws)), "
        "hits AS (SELECT doc_id, id, label, size, pos, place, pos - place AS d FROM dg JOIN tg USING (g)), "
        "lines AS (SELECT DISTINCT doc_id, id, d FROM hits), "
        f"starts AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, id ORDER BY d) <= {L.NEAR} THEN 0 ELSE 1 END AS s FROM lines), "
        "spans AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, id ORDER BY d) AS span FROM starts), "
        f"covered AS (SELECT doc_id, id, label, size, span, unnest(range(pos, pos + {L.K})) AS dw, unnest(range(place, place + {L.K})) AS tw FROM hits JOIN spans USING (doc_id, id, d)), "
        "found AS (SELECT doc_id, id, label, span, least(count(DISTINCT dw), count(DISTINCT tw)) / any_value(size) AS coverage FROM covered GROUP BY doc_id, id, label, span, size "
        f"HAVING least(count(DISTINCT dw), count(DISTINCT tw)) / any_value(size) >= {L.COVER} AND max(dw) - min(dw) + 1 <= {L.LONGEST} * size), "
        "b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1), "
        "f AS (SELECT doc_id, max(least(1.0, coverage)) AS best, count(*) AS n_notices FROM found GROUP BY 1), "
        "labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY 1) "
        "SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, "
        "CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, coalesce(n_notices, 0) AS n_notices FROM w LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN labelled USING (doc_id)"
    )


ORACLES["op9_license_scan"] = _license_sql()


@_query
def op10_token_counts(spark, sf_dir):
    from loomnote.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), limit=1024)
