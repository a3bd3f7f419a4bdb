"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, html_text, jaccard, langid, secret_scan, substring, urls
from .common import table


def tokenizer() -> tuple[str, str]:
    """File and pattern of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of each vector whose id is divisible by 100, among all vectors of its length."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that holds control strings, as read back from their ids."""
    own = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = turns.unionByName(spark.createDataFrame(own, "conv_id bigint, turn bigint, role string, text string"))
    read = chat.read_back(both, *tokenizer())
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all whole texts, by the patterns and by models trained on the table's own words."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digests(secret_scan.scan(docs, secret_scan.fit(docs)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of what they decode to, for all whole texts."""
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), *tokenizer()))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all addresses, by rules, else by a model whose lexicon is fitted on all documents' words."""
    model = urls.fit(table(spark, sf_dir, "documents"))
    return urls.judge(table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all whole texts, learned from rows whose remainder is not 2; rejected says that the pipeline would drop the row."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    held = F.coalesce(langid.remainder(F.col("id")) == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents without windows of 20 words that start earlier."""
    return substring.digests(substring.dedup(table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of all documents."""
    return jaccard.link(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"), counted=False)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in all documents; contaminated from two items on."""
    return decontam.verdicts(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nearest, op2_chat_format, op3_secret_scan, op4_byte_bpe, op5_url_filter, op6_language_id, op7_substring_dedup, op8_jaccard_join, op9_html_text, op10_decontaminate)
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_MARKED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|SYS\]|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g')"

#: SQL for the queries that have no trained model, tokenizer or approximation in their results.
SQL: dict[str, str] = {
    "op2_chat_format": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length({_ESCAPED.format("text")}) + 7 + case role when 'system' then 5 when 'user' then 6 when 'assistant' then 7 else 13 + length({_ESCAPED.format("role")}) end as size from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from sized group by conv_id""",
    "op7_substring_dedup": f"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as words from documents),
starts as (select doc_id, words, unnest(range(0, len(words) - 19)) as s from docs where len(words) >= 20),
windows as (select doc_id, s, array_to_string(list_slice(words, s + 1, s + 20), ' ') as w from starts),
ranked as (select doc_id, s, row_number() over (partition by w order by doc_id, s) as k from windows),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(s, s + 20)) as i from ranked where k > 1)),
each as (select doc_id, unnest(words) as word, unnest(range(0, len(words))) as i from docs),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) as text, count(*) as n from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i where g.i is null group by e.doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs d left join kept k on k.doc_id = d.doc_id""",
    "op8_jaccard_join": f"""
with recursive docs as (select doc_id, regexp_extract_all({_LOWERED}, {_SPACED}) as words from documents),
starts as (select doc_id, words, unnest(range(0, greatest(len(words) - 4, 1))) as s from docs where len(words) > 0),
shingles as (select distinct doc_id, array_to_string(list_slice(words, s + 1, s + 5), ' ') as t from starts),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
both_have as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from both_have join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
ways as (select x as a, y as b from links union select y, x from links),
reach as (select a, b from ways union select r.a, w.b from reach r join ways w on w.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(least(d.doc_id, m), d.doc_id) as component_id
from docs d left join sizes s on s.doc_id = d.doc_id left join (select a, min(b) as m from reach group by a) r on r.a = d.doc_id""",
    "op9_html_text": r"""
with blocks as (select page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>') as parts from pages),
each as (select page_id, url, unnest(parts) as part, unnest(range(0, len(parts))) as i from blocks),
plain as (select page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as part from each),
texts as (select page_id, string_agg(part, chr(10) order by i) as text from plain where part <> '' group by page_id)
select p.page_id, p.url, coalesce(text, '') as text, cast(length(coalesce(text, '')) as bigint) as n_chars from pages p left join texts t on t.page_id = p.page_id""",
    "op10_decontaminate": f"""
with docs as (select doc_id, regexp_extract_all({_LOWERED}, {_MARKED}) as words from documents),
items as (select item_id, regexp_extract_all({_LOWERED}, {_MARKED}) as words from benchmark where item_id is not null),
sized as (select item_id, words, least(len(words), 8) as size from items where len(words) > 0),
item_windows as (select distinct item_id, size, array_to_string(list_slice(words, s + 1, s + size), ' ') as w from (select *, unnest(range(0, len(words) - size + 1)) as s from sized)),
lengths as (select distinct size from sized),
doc_windows as (select doc_id, s, size, array_to_string(list_slice(words, s + 1, s + size), ' ') as w from (select doc_id, words, size, unnest(range(0, len(words) - size + 1)) as s from docs, lengths where len(words) >= size)),
hits as (select doc_id, s, d.size, item_id from doc_windows d join item_windows i on i.size = d.size and i.w = d.w),
covered as (select doc_id, count(distinct i) as n from (select doc_id, unnest(range(s, s + size)) as i from hits) group by doc_id),
who as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as list from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(c.n, 0) as n_hit, coalesce(w.n, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(w.n, 0) >= 2 as contaminated
from docs d left join covered c on c.doc_id = d.doc_id left join who w on w.doc_id = d.doc_id""",
}
