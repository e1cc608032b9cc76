"""Registered queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import (
    byte_bpe,
    conversation_trie,
    embedding_dups,
    fingerprints,
    hmm,
    merkle,
    minhash,
    packing,
    secrets,
    sentencepiece_fst,
    substring_dedup,
    toxicity,
    url_rules,
)
from nearfield.llm.steps import bounded_batches
from nearfield.llm.url_rules import Rule

SITE_RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)
PATTERN_RULES = (
    Rule("spam-farm.", "block", site=False),
    Rule("cheap-pills.", "block", site=False),
    Rule("/ads/", "block", site=False),
    Rule("free-*-download", "block", site=False),
)

def tampered() -> Column:
    """Rows whose copy is tampered with; those with a null id are not."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def piece_model() -> str:
    """The public SentencePiece model; its package is on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_fst.round_trips(_documents(spark, sf), piece_model())


def op2_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf))


def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return url_rules.judge_urls(pages, SITE_RULES + PATTERN_RULES)


def word_tokenizer() -> str:
    """The public tokenizer that packing uses; its package is on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf), word_tokenizer())


def op5_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.score_language(_documents(spark, sf))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))


def op7_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_documents(spark, sf))


def op8_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dups.near_duplicate_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.dedup_report(_documents(spark, sf))


def op10_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verify_manifest(_documents(spark, sf), {"n_chars": F.col("n_chars") + 1}, tampered())


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return conversation_trie.conversation_trie(conversations, taken)


def byte_vocabulary() -> str:
    """The public byte-level vocabulary; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op13_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.round_trips(_documents(spark, sf), byte_vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_url_filters": op3_url_filters,
        "op4_packing": op4_packing,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_toxicity": op6_toxicity,
        "op7_document_fingerprints": op7_document_fingerprints,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_secret_scans": op10_secret_scans,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_byte_bpe": op13_byte_bpe,
    }


def _url_sql() -> str:
    sites = ", ".join(
        f"({i}, '{r.text}', '{r.host}', '{r.text[len(r.host):]}', '{r.verdict}')"
        for i, r in enumerate(SITE_RULES)
    )
    patterns = ", ".join(
        f"('{r.text}', '%{r.text.replace('*', '%')}%')" for r in PATTERN_RULES
    )
    return f"""with u as (select page_id, url, row_number() over () as r, case when contains(url, '://')
            then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        p as (select page_id, r, translate(regexp_extract(rest, '^[^/?#]*'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
        sites(i, text, h, pre, verdict) as (values {sites}),
        fit as (select r, text, verdict, row_number() over (partition by r
                    order by length(text) desc, length(h) desc, text) as n from p join sites
                on (host = h or host like '%.' || h) and starts_with(path, pre)),
        pats(text, shape) as (values {patterns}),
        hit as (select r, text, row_number() over (partition by r order by length(text) desc,
                    length(split_part(text, '/', 1)) desc, text) as n
                from p join pats on host || path like shape)
        select page_id, host, path, fit.text as rule,
            coalesce(fit.verdict, case when hit.text is not null then 'block' else 'allow' end) as verdict,
            case when fit.text is null then hit.text end as pattern
        from p left join fit on fit.r = p.r and fit.n = 1 left join hit on hit.r = p.r and hit.n = 1"""


# CRC-32 of the text {s} of ASCII characters.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"
    crc = _CRC32.format(s="doc_id::varchar")
    return f"""with recursive leaves as (select row_number() over () as r, doc_id, lang, {leaf("n_chars")} as leaf,
            case when {crc} % 7 = 0 then {leaf("(n_chars + 1)")} end as changed from documents),
        placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
            count(*) over (partition by lang) as n from leaves),
        nodes(lang, lvl, pos, n, h) as (select lang, 0, pos, n, leaf from placed union all
            select lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos))
            from nodes where n > 1 group by lang, lvl, pos // 2, (n + 1) // 2),
        subroots as (select lang, lvl as height, h as subroot,
            row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
        upper_nodes(lvl, pos, n, h) as (select 0, pos, n, subroot from subroots union all
            select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos))
            from upper_nodes where n > 1 group by lvl, pos // 2, (n + 1) // 2),
        roots as (select lvl as height, h as root from upper_nodes where n = 1),
        climb(r, lang, lvl, pos, h, proof) as (select r, lang, 0, pos, coalesce(changed, leaf), '' from placed union all
            select c.r, c.lang, c.lvl + 1, c.pos // 2, sha256(case when c.pos % 2 = 0 then c.h || coalesce(s.h, '')
                else s.h || c.h end), c.proof || coalesce(s.h, '')
            from climb c join subroots t on c.lang is not distinct from t.lang and c.lvl < t.height
            left join nodes s on s.lang is not distinct from c.lang and s.lvl = c.lvl and s.pos = xor(c.pos, 1)),
        climb_on(r, lvl, pos, h, proof) as (select c.r, 0, t.pos, c.h, c.proof from climb c
            join subroots t on c.lang is not distinct from t.lang and c.lvl = t.height union all
            select c.r, c.lvl + 1, c.pos // 2, sha256(case when c.pos % 2 = 0 then c.h || coalesce(s.h, '')
                else s.h || c.h end), c.proof || coalesce(s.h, '')
            from climb_on c join roots on c.lvl < height left join upper_nodes s on s.lvl = c.lvl and s.pos = xor(c.pos, 1))
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, c.h as folded_root, c.h = root as verified
        from placed p join subroots t on p.lang is not distinct from t.lang cross join roots
        join climb_on c on c.r = p.r and c.lvl = roots.height"""


def _trie_sql() -> str:
    crc = _CRC32.format(s="conv_id::varchar")
    return f"""with turns as (select conv_id, coalesce(text, '') as text, row_number() over (partition by conv_id
            order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p,
            strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as body
            from conversations where conv_id is not null),
        whole as (select conv_id, list(sha256(body) order by p) as ids,
            list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) order by p) as words from turns group by conv_id),
        takes as (select *, {crc} % 4 as h from whole),
        paths as (select a.conv_id, list_concat(coalesce(b.ids[:a.h], []), a.ids[a.h + 1:]) as ids,
            list_concat(coalesce(b.words[:a.h], []), a.words[a.h + 1:]) as words
            from takes a left join whole b on b.conv_id = a.conv_id - a.conv_id % 20),
        steps as (select conv_id, ids[:d] as path, d, words[d] as w, len(ids) = d as ends
            from (select *, unnest(range(0, len(ids) + 1)) as d from paths)),
        nodes as (select path, d, min(conv_id) as conv_id, count(*) as n, max(w) as w,
            sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
            from steps group by path, d),
        kids as (select path[:d - 1] as path, count(*) as n_children from nodes where d > 0 group by 1),
        own as (select nodes.*, coalesce(n_children, 0) as n_children, case when d > 0 then (n - 1) * w else 0 end as saved
            from nodes left join kids on nodes.path = kids.path),
        sums as (select path[:e] as path, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
            from (select *, unnest(range(0, d + 1)) as e from own) group by 1)
        select own.conv_id, own.d as depth, up.conv_id as parent_conv_id, own.n as n_convs, own.n_children, n_leaves,
            saved_tokens, own.ends_sha256
        from own join sums on own.path = sums.path left join nodes up on own.d > 0 and up.path = own.path[:own.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": _url_sql(),
        "op11_merkle_manifest": _merkle_sql(),
        "op12_conversation_trie": _trie_sql(),
    }
