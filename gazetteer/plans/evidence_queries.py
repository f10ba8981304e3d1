"""Queries over documents: folding, quotes, tags, claims, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions import text as T
from gazetteer.functions.regex import java
from gazetteer.operators import evidence as E
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import view
from gazetteer.plans.web_queries import SP, sql_fold

# Frequent words of the four languages, a phrase, and one with a look-behind.
PATTERNS = {
    "of": r"\bof\b", "der": r"\bder\b", "que": r"\bque\b", "los": r"\blos\b",
    "of the": r"\bof the\b", "the, not of the": r"(?<!of )\bthe\b",
}
SINGLE = {k: len(k) for k in ("of", "der", "que", "los")}
_NOT_KIDS = vocab.NOT_ABOUT_KIDS.replace("'", "''")


def sql_squash(c: str) -> str:
    t = f"lower({c})"
    for a, b in (("‘", "''"), ("’", "''"), ("ʼ", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "...")):
        t = f"replace({t}, '{a}', '{b}')"
    return sql_fold(t)


def _docs(spark, d):
    return view(spark, d, "documents").select(
        F.col("source").alias("provider"), F.col("doc_id").alias("_ord"), F.col("doc_id").alias("page_id"),
        F.col("lang").alias("label"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "text")


_TAIL = " Kids&#8217;  A&#x26;B &ndash; &amp;lt; ‘x’ “y”… &#99999999999; &unknown; &NBSP;End"


@query("q_squash", f"""SELECT doc_id, {sql_fold(sql_squash('text') + " || ' ' || 'kids'' a&b - &lt; ''x'' " + '"y"' + "... &#99999999999; &unknown; end'")} AS folded FROM documents""")
def squash(spark, d):
    return view(spark, d, "documents").select(
        "doc_id", T.squash(F.concat(F.col("text"), F.lit(_TAIL))).alias("folded"))


SQL_MATCHES = "matches AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, source, '{w}' AS name, {n} AS len, text, i,
      sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {n} AS pos, cnt FROM
      (SELECT doc_id, source, text, unnest(s) AS seg, unnest(range(1, len(s) + 1)) AS i, len(s) AS cnt FROM
        (SELECT doc_id, source, text, regexp_split_to_array(text, '(?i)\\b{w}\\b') AS s FROM documents)) QUALIFY i < cnt"""
    for w, n in SINGLE.items()) + ")"


@query("q_match_positions", f"""WITH {SQL_MATCHES} SELECT doc_id, name, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total, CAST(max(pos) AS BIGINT) AS last
  FROM matches GROUP BY 1, 2""")
def match_positions(spark, d):
    docs = view(spark, d, "documents")
    found = F.explode(F.array(*[
        F.struct(F.lit(w).alias("name"), T.match_positions(F.col("text"), java(PATTERNS[w])).alias("m")) for w in SINGLE]))
    return docs.select("doc_id", found.alias("f")).where("size(f.m) > 0").select(
        "doc_id", "f.name", F.size("f.m").cast("bigint").alias("n"),
        F.aggregate("f.m", F.lit(0).cast("bigint"), lambda a, m: a + m["pos"]).alias("total"),
        F.array_max(F.transform("f.m", lambda m: m["pos"])).cast("bigint").alias("last"))


def _last(c: str, mark: str) -> str:
    rev = mark[::-1]
    return f"CASE WHEN strpos(reverse({c}), '{rev}') > 0 THEN length({c}) - strpos(reverse({c}), '{rev}') - 1 ELSE -1 END"


# Oracle steps from (text, pos, len) to the quote.
SQL_QUOTES = f"""q1 AS (SELECT *, greatest(0, pos - 90) AS lo, least(length(text), pos + len + 90) AS hi FROM matches),
  q2 AS (SELECT *, substr(text, lo + 1, pos - lo) AS bef, substr(text, pos + len + 1, hi - pos - len) AS aft,
    substr(text, pos + len + 2, hi - pos - len) AS tail FROM (SELECT * REPLACE (CAST(pos AS BIGINT) AS pos, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi) FROM q1)),
  q3 AS (SELECT *, greatest({_last('bef', '. ')}, {_last('bef', '! ')}, {_last('bef', '? ')}) AS stop,
    CASE WHEN regexp_matches(aft, '[.!?]({SP}|\\z)') THEN length(regexp_extract(aft, '^([\\s\\S]*?)[.!?]({SP}|\\z)', 1)) ELSE -1 END AS nxt FROM q2),
  q4 AS (SELECT *, CASE WHEN stop >= 0 THEN lo + stop + 2 WHEN lo > 0 THEN CASE WHEN strpos(bef, ' ') > 0 THEN lo + strpos(bef, ' ') ELSE pos END ELSE lo END AS b,
    CASE WHEN nxt >= 0 THEN pos + len + nxt + 1 WHEN hi < length(text) AND strpos(reverse(tail), ' ') > 0 THEN pos + len + 1 + length(tail) - strpos(reverse(tail), ' ') ELSE hi END AS e FROM q3),
  quotes AS (SELECT doc_id, source, name, pos, regexp_replace(substr(text, b + 1, e - b), '\\A{SP}+|{SP}+\\z', '', 'g') AS quote FROM q4)"""
_WORDS = f"list_filter(regexp_split_to_array({{c}}, '{SP}+'), lambda w: regexp_matches(w, '^[A-Za-z]'))"


def sql_usable(c: str) -> str:
    w = _WORDS.replace('{c}', c)
    return (f"(length({c}) >= 8 AND NOT regexp_matches({c}, '(?i){_NOT_KIDS}') AND NOT (NOT regexp_matches({c}, '[.!?]\\z') AND len({w}) >= 10 "
            f"AND len(list_filter({w}, lambda w: regexp_matches(w, '^[A-Z]'))) / len({w}) > 0.6))")


@query("q_quote_around", f"""WITH {SQL_MATCHES}, {SQL_QUOTES} SELECT doc_id, name, quote FROM quotes QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY pos) = 1""")
def quote_around(spark, d):
    found = F.explode(F.array(*[
        F.struct(F.lit(w).alias("name"), F.get(T.match_positions(F.col("text"), java(PATTERNS[w])), F.lit(0)).alias("m")) for w in SINGLE]))
    return view(spark, d, "documents").select("doc_id", "text", found.alias("f")).where("f.m IS NOT NULL").select(
        "doc_id", "f.name", T.quote_around(F.col("text"), F.col("f.m.pos"), F.col("f.m.len")).alias("quote"))


@query("q_quote_around_all", f"""WITH {SQL_MATCHES}, {SQL_QUOTES} SELECT doc_id, name, pos, quote FROM quotes""")
def quote_around_all(spark, d):
    """A quote around every match, where q_quote_around shows the first one of each word."""
    text = F.col("text")

    def quotes(word):
        return F.transform(T.match_positions(text, java(PATTERNS[word])), lambda m: F.struct(
            F.lit(word).alias("name"), m["pos"].cast("bigint").alias("pos"), T.quote_around(text, m["pos"], m["len"]).alias("quote")))

    quoted = F.flatten(F.array(*[quotes(w) for w in SINGLE]))
    return view(spark, d, "documents").select("doc_id", F.explode(quoted).alias("q")).select("doc_id", "q.*")


@query("q_usable_quote", f"""SELECT doc_id, count(*) FILTER ({sql_usable('line')}) AS usable, count(*) AS lines FROM
  (SELECT doc_id, unnest(split(text || chr(10) || 'Home About Programs Adult' || chr(10) || 'One Two Three Four Five Six Seven Eight Nine Ten', chr(10))) AS line FROM documents) GROUP BY 1""")
def usable_quote(spark, d):
    more = "\nHome About Programs Adult\nOne Two Three Four Five Six Seven Eight Nine Ten"
    lines = view(spark, d, "documents").select("doc_id", F.explode(F.split(F.concat("text", F.lit(more)), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count_if(T.usable_quote(F.col("line"))).alias("usable"), F.count(F.lit(1)).alias("lines"))


@query("q_keyword_evidence", f"""WITH {SQL_MATCHES}, {SQL_QUOTES} SELECT source AS provider, name, doc_id AS _ord, quote FROM quotes WHERE {sql_usable('quote')}
  QUALIFY row_number() OVER (PARTITION BY source, name ORDER BY doc_id, pos) = 1""")
def keyword_evidence(spark, d):
    return E.keyword_evidence(_docs(spark, d), {k: PATTERNS[k] for k in SINGLE}).select("provider", "name", "_ord", "quote")


@query("q_keyword_evidence_phrases")
def keyword_evidence_phrases(spark, d):
    """Patterns with blanks and a look-behind, which DuckDB cannot state."""
    return E.keyword_evidence(_docs(spark, d), PATTERNS).select("provider", "name", "_ord", "quote")


_PHRASES = ["our robotics club", "Arts &amp; Crafts and LEGO", "digital literacy class", "chess, yoga and creative writing"]
_ADDED = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"


def _rx(p: str) -> str:
    return p.replace("(?<!(financial|digital|media|computer) )", "").replace("'", "''")


@query("q_tag_text", f"""WITH t AS (SELECT doc_id, text || ' ' || {_ADDED} AS text FROM documents), u AS (SELECT doc_id, text, regexp_replace(text, '(?i)(financial|digital|media|computer) literacy', '', 'g') AS cut FROM t)
  SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '(?i){_rx(p)}') THEN '{n}' END" for n, p in vocab.TOOL_PATTERNS.items())}], lambda x: x IS NOT NULL), '|') AS tools,
  array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches({'cut' if n == 'literacy & writing' else 'text'}, '(?i){_rx(p)}') THEN '{n}' END" for n, p in vocab.SUBJECT_PATTERNS.items())}], lambda x: x IS NOT NULL), '|') AS subjects FROM u""")
def tag_text(spark, d):
    text = F.concat(F.col("text"), F.lit(" "), F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % 4 + 1).cast("int")))
    return view(spark, d, "documents").withColumn("text", text).select(
        "doc_id", F.array_join(T.tags(F.col("text"), vocab.TOOL_PATTERNS), "|").alias("tools"),
        F.array_join(T.tags(F.col("text"), vocab.SUBJECT_PATTERNS), "|").alias("subjects"))


@query("q_contacts", r"""SELECT doc_id, regexp_extract(text, '[\w.+-]+@[\w-]+\.[\w.]+') AS email, regexp_extract(text, '\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}') AS phone FROM documents""")
def contacts(spark, d):
    return view(spark, d, "documents").select(
        "doc_id", T.first_email(F.col("text")).alias("email"), T.first_phone(F.col("text")).alias("phone"))


@query("q_has_program", f"""SELECT doc_id, regexp_matches(text || {_ADDED}, '(?i){vocab.HAS_PROGRAM}') OR doc_id % 5 = 0 AS found FROM documents""")
def has_program(spark, d):
    added = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % 4 + 1).cast("int"))
    after = F.when(F.col("doc_id") % 5 == 0, " our After School hours").otherwise("")
    return view(spark, d, "documents").select(
        "doc_id", T.has_program(F.concat("text", added, after)).alias("found"))


SQL_CLAIMED = f"""t AS (SELECT doc_id, source, {sql_squash('text')} AS t FROM documents), c AS (SELECT *, {sql_squash('quote')} AS q FROM claims),
  hits AS (SELECT claim_id, count(*) AS n FROM c JOIN t ON contains(t.t, c.q) GROUP BY 1)"""


@query("q_verify_quotes", f"""WITH {SQL_CLAIMED} SELECT c.claim_id, coalesce(n, 0) AS pages_found, item_id % 10 <> 9 AND coalesce(n, 0) > 0 AS ok
  FROM c LEFT JOIN hits ON hits.claim_id = c.claim_id""", ("claims",))
def verify_quotes(spark, d):
    claims = view(spark, d, "claims")
    labels = claims.where("item_id % 10 <> 9").select("label")
    return E.verify_quotes(claims, _docs(spark, d), labels).select("claim_id", "pages_found", "ok")


@query("q_first_quote", f"""WITH {SQL_CLAIMED}, k AS (SELECT c.*, coalesce(n, 0) > 0 AS ok, item_id % 3 AS grp FROM c LEFT JOIN hits ON hits.claim_id = c.claim_id)
  SELECT grp, label, claim_id, CAST(NULL AS BIGINT) AS dropped FROM k WHERE ok QUALIFY row_number() OVER (PARTITION BY grp, label ORDER BY claim_id) = 1
  UNION ALL SELECT grp, NULL, NULL, count(*) FILTER (NOT ok) FROM k GROUP BY grp""", ("claims",))
def first_quote(spark, d):
    checked = E.verify_quotes(view(spark, d, "claims"), _docs(spark, d)).withColumns(
        {"grp": F.col("item_id") % 3, "_ord": F.col("claim_id")})
    kept, dropped = E.first_quote(checked, "grp")
    none = F.lit(None)
    return kept.select("grp", "label", "claim_id", none.cast("bigint").alias("dropped")).unionByName(
        dropped.select("grp", none.cast("string").alias("label"), none.cast("bigint").alias("claim_id"), "dropped"))


@query("q_corpus", """SELECT source AS provider, left(string_agg('## ' || lang || ' (doc/' || doc_id || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id), 60000) AS corpus
  FROM documents GROUP BY 1""")
def corpus(spark, d):
    return E.corpus(_docs(spark, d)).select("provider", "corpus")


_TOOLS_ALL = I.sql_list(vocab.TOOL_VOCAB)


@query("q_gate_evidence", f"""SELECT _ord, array_to_string(CASE WHEN len(ev) > 0 THEN known ELSE [] END, '|') AS tools, len(ev) AS quotes,
  CASE WHEN len(ev) = 0 THEN len(known) ELSE 0 END AS dropped, CASE WHEN len(ev) = 0 AND len(known) > 0 THEN 'low' ELSE confidence END AS confidence FROM
  (SELECT _ord, fact_confidence AS confidence, list_filter(CASE WHEN tools_text = '' THEN [] ELSE split(tools_text, ',') END, lambda t: t IN ({_TOOLS_ALL})) AS known,
   list_filter(split(evidence_text, ','), lambda e: trim(e) <> '') AS ev FROM facts_raw)""", ("facts_raw",))
def gate_evidence(spark, d):
    scored = I.facts(spark, d).select("_ord", "stem_tools", "evidence", F.col("fact_confidence").alias("confidence"))
    return E.gate_evidence(scored).select(
        "_ord", F.array_join("stem_tools", "|").alias("tools"), F.size("evidence").cast("bigint").alias("quotes"),
        F.col("dropped_unevidenced").cast("bigint").alias("dropped"), "confidence")


@query("q_keyword_facts", f"""WITH t AS (SELECT source, doc_id, text, regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+') AS email,
    regexp_extract(text, '\\(?\\d{{3}}\\)?[-.\\s]\\d{{3}}[-.\\s]\\d{{4}}') AS phone FROM documents)
  SELECT source AS provider, bool_or(regexp_matches(text, '(?i){vocab.HAS_PROGRAM}')) AS has_program,
    coalesce(arg_min(email, doc_id) FILTER (email <> ''), '') AS contact_email, coalesce(arg_min(phone, doc_id) FILTER (phone <> ''), '') AS contact_phone,
    'unknown' AS cost_tier, 'low' AS confidence, 'keyword' AS method FROM t GROUP BY 1""")
def keyword_facts(spark, d):
    return E.keyword_facts(_docs(spark, d)).select(
        "provider", "has_program", "contact_email", "contact_phone", "cost_tier", "confidence", "method")


_STOP = I.sql_list(vocab.QUESTION_STOPWORDS)
_QW = f"list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


@query("q_keyword_search", f"""WITH asked AS (SELECT vec AS qid, lower(replace(replace(q, chr(39), ''), '’', '')) AS q FROM (SELECT doc_id AS vec, array_to_string(split(text, ' ')[2:4], ' ') AS q FROM documents)),
  w AS (SELECT qid, {_QW} AS w FROM asked), t AS (SELECT doc_id, lower(text) AS t FROM documents)
  SELECT qid, doc_id AS text_id FROM w JOIN t ON len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(t, x))) = 0""")
def keyword_search(spark, d):
    docs = view(spark, d, "documents")
    three = F.array_join(F.slice(F.split("text", " "), 2, 3), " ")
    asked = docs.select(
        F.col("doc_id").alias("qid"), F.regexp_replace(F.lower(three), "['’]", "").alias("q"))
    return E.keyword_search(asked, docs.select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")))


@query("q_keyword_search_all", f"""WITH asked AS (SELECT lower(replace(replace(q, chr(39), ''), '’', '')) AS q FROM (SELECT array_to_string(split(text, ' ')[2:4], ' ') AS q FROM documents)),
  w AS (SELECT coalesce(array_to_string(list_sort(list_distinct({_QW})), ' '), '') AS words, count(*) AS questions FROM asked GROUP BY 1), t AS (SELECT doc_id, lower(text) AS t FROM documents)
  SELECT words, questions, doc_id AS text_id FROM w LEFT JOIN t ON words <> '' AND len(list_filter(split(words, ' '), lambda x: NOT contains(t, x))) = 0""")
def keyword_search_all(spark, d):
    """Questions from the texts of every language, answered once per distinct set of words."""
    docs = view(spark, d, "documents")
    three = F.array_join(F.slice(F.split("text", " "), 2, 3), " ")
    asked = docs.select(F.regexp_replace(F.lower(three), "['’]", "").alias("q"))
    return E.keyword_sets(asked, docs.select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")))


@query("q_keyword_answers", f"""WITH asked AS (SELECT lower(replace(replace(q, chr(39), ''), '’', '')) AS q FROM (SELECT array_to_string(split(text, ' ')[2:4], ' ') AS q FROM documents)),
  w AS (SELECT coalesce(array_to_string(list_sort(list_distinct({_QW})), ' '), '') AS words, count(*) AS questions FROM asked GROUP BY 1), t AS (SELECT doc_id, lower(text) AS t FROM documents),
  p AS (SELECT words, doc_id, row_number() OVER (PARTITION BY words ORDER BY doc_id) AS rn FROM w JOIN t ON words <> '' AND len(list_filter(split(words, ' '), lambda x: NOT contains(t, x))) = 0)
  SELECT w.words, w.questions, count(p.doc_id) AS total, coalesce(string_agg(p.doc_id::VARCHAR, ' ' ORDER BY p.doc_id) FILTER (p.rn <= 8), '') AS first FROM w LEFT JOIN p ON p.words = w.words GROUP BY 1, 2""")
def keyword_answers(spark, d):
    """What the search answers: how many texts hold all words of a set, and the first eight."""
    docs = view(spark, d, "documents")
    three = F.array_join(F.slice(F.split("text", " ", 5), 2, 3), " ")  # the fifth part, the rest, is not looked at
    asked = docs.select(F.regexp_replace(F.lower(three), "['’]", "").alias("q"))
    found = E.keyword_answers(asked, docs.select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")))
    return found.withColumn("first", F.array_join(F.transform("first", lambda x: x.cast("string")), " "))
