"""Queries on text normalisation. The SQL spells the rules with the operators RE2 has:
it has no lookaround, so neighbours are captured and put back, twice where matches can touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentlab.checks.registry import query
from segmentlab.checks.views import with_views
from segmentlab.functions import fixed
from segmentlab.checks.views import NOT_SPACE, SPACE
from segmentlab.functions.text import WRONG_SCRIPT
from segmentlab.operators import normalize as n
from segmentlab.plans.corpus_text import RULES, hit_report, normalize_corpus

D = r"\p{Nd}"
LETTER = "[A-Za-zÀ-ỹ]"
TRIM = f"'^{SPACE}+|{SPACE}+$', '', 'g'"


def sub(text: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def squeezed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{SPACE}{{2,}}', ' ', 'g'), {TRIM})"


def bare(text: str) -> str:
    return squeezed(sub(text, (WRONG_SCRIPT, ""), (f"{SPACE}+([,.;:!?])", r"\1")))


ADDRESS = rf"(?i)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+|\b[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+\b"


def cleaned(text: str) -> str:
    return sub(f"nfc_normalize({text})", (ADDRESS, " "), (f"({LETTER})({D})", r"\1 \2"), (f"({D})({LETTER})", r"\1 \2"))


def ranged(text: str, joiner: str) -> str:
    rule = (f"({D}){SPACE}*-{SPACE}*({D})", rf"\1 {joiner} \2")
    return sub(text, rule, rule)


AMOUNT = rf"({D}[{D}.,]*)"


def early(text: str) -> str:
    plus, equals = ((f"({D}){SPACE}*{s}{SPACE}*({D})", rf"\1 {w} \2") for s, w in ((r"\+", "cộng"), ("=", "bằng")))
    return sub(text, (rf"{AMOUNT}{SPACE}*[đ₫]([^\p{{L}}\p{{N}}_À-ỹ]|$)", r"\1 đồng\2"),
               (rf"(?i){AMOUNT}{SPACE}*VND\b", r"\1 đồng"), plus, plus, equals, equals)


def late(text: str) -> str:
    return sub(text, (f"({D}){SPACE}*%", r"\1 phần trăm"), (rf"\${SPACE}*{AMOUNT}", r"\1 đô la"), (rf"{AMOUNT}{SPACE}*\$", r"\1 đô la"),
               (rf"({D}){SPACE}*đ([^\p{{L}}\p{{N}}_]|$)", r"\1 đồng\2"), (rf"({D}){SPACE}*₫([\p{{L}}\p{{N}}_])", r"\1 đồng\2"),
               (rf"{AMOUNT}{SPACE}*VND\b", r"\1 đồng"), (f"{SPACE}*&{SPACE}*", " và "))


def english(text: str) -> str:
    return sub(text, (f"({D}){SPACE}*%", r"\1 percent"), (rf"\${SPACE}*{AMOUNT}", r"\1 dollars"),
               (rf"{AMOUNT}{SPACE}*\$", r"\1 dollars"), (f"{SPACE}*&{SPACE}*", " and "))


NUMBER = rf"{D}[{D}.,]*{D}|{D}"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Readings of 0..999 and of every distinct token, as tables: v3, e3, then words_<lang>(token, said).
TRIPLETS = f"""
digits3 AS (SELECT k AS num, k // 100 AS h, k // 10 % 10 AS t, k % 10 AS u FROM range(1000) r(k)),
v3 AS (
  SELECT num, full_read, trim(concat_ws(' ',
      CASE WHEN num > 0 AND (h > 0 OR full_read) THEN {sql_list(fixed.VI_DIGITS)}[h + 1] || ' trăm' END,
      CASE WHEN t = 1 THEN 'mười' WHEN t > 1 THEN {sql_list(fixed.VI_DIGITS)}[t + 1] || ' mươi'
           WHEN u > 0 AND (h > 0 OR full_read) THEN 'lẻ' END,
      CASE WHEN u = 0 THEN NULL WHEN t > 1 AND u = 1 THEN 'mốt' WHEN t > 1 AND u = 4 THEN 'tư' WHEN t > 0 AND u = 5 THEN 'lăm'
           ELSE {sql_list(fixed.VI_DIGITS)}[u + 1] END)) AS said
  FROM digits3, (SELECT true AS full_read UNION ALL SELECT false) f),
e3 AS (
  SELECT num, trim(concat_ws(' ', CASE WHEN h > 0 THEN {sql_list(fixed.EN_DIGITS)}[h + 1] || ' hundred' END,
      CASE WHEN t = 1 THEN {sql_list(fixed.EN_TEENS)}[u + 1]
           WHEN t > 1 THEN {sql_list(fixed.EN_TENS)}[t + 1] || CASE WHEN u > 0 THEN '-' || {sql_list(fixed.EN_DIGITS)}[u + 1] ELSE '' END
           WHEN u > 0 THEN {sql_list(fixed.EN_DIGITS)}[u + 1] END)) AS said
  FROM digits3)
"""


def spelled(text: str, names: list[str]) -> str:
    return (f"array_to_string(list_transform(string_split({text}, ''), lambda d: {sql_list(names)}[ascii(d) - 47]), ' ')")


def vi_words(tokens: str) -> str:
    """CTEs that read the distinct tokens of table ``tokens(token)`` in Vietnamese into ``words_vi``."""
    return f"""
vp AS (SELECT token,
    CASE WHEN contains(token, ',') THEN regexp_replace(split_part(token, ',', 1), '[^0-9]', '', 'g')
         WHEN len(string_split(token, '.')) = 2 AND length(split_part(token, '.', 2)) <> 3 THEN split_part(token, '.', 1)
         ELSE replace(token, '.', '') END AS w0,
    CASE WHEN contains(token, ',') THEN regexp_replace(substr(token, instr(token, ',') + 1), '[^0-9]', '', 'g')
         WHEN len(string_split(token, '.')) = 2 AND length(split_part(token, '.', 2)) <> 3 THEN split_part(token, '.', 2)
         ELSE '' END AS frac FROM {tokens}),
vw AS (SELECT token, CASE WHEN w0 = '' THEN '0' ELSE w0 END AS whole, frac FROM vp),
vg AS (SELECT token, k, (length(whole) + 2) // 3 AS n, cast(substr(lpad(whole, 18, '0'), k * 3 + 1, 3) AS INTEGER) AS num
       FROM vw, range(6) r(k) WHERE length(whole) <= 18 AND NOT (length(whole) > 1 AND whole[1] = '0')),
vr AS (SELECT g.token, string_agg(v.said || {sql_list(fixed.VI_SCALES)}[6 - k], ' ' ORDER BY k) AS said
       FROM vg g JOIN v3 v ON v.num = g.num AND v.full_read = (k > 6 - n) WHERE g.num > 0 GROUP BY g.token),
words_vi AS (SELECT w.token, CASE WHEN whole = '0' THEN 'không'
       WHEN length(whole) > 18 OR length(whole) > 1 AND whole[1] = '0' THEN {spelled('whole', fixed.VI_DIGITS)} ELSE r.said END ||
       CASE WHEN frac <> '' THEN ' phẩy ' || {spelled('frac', fixed.VI_DIGITS)} ELSE '' END AS said
       FROM vw w LEFT JOIN vr r ON r.token = w.token)"""


def en_words(tokens: str) -> str:
    return f"""
ep AS (SELECT token, len(string_split(token, '.')) - 1 AS dots, ltrim(split_part(replace(token, ',', ''), '.', 1), '0') AS whole,
       split_part(replace(token, ',', ''), '.', 2) AS frac FROM {tokens}),
eg AS (SELECT token, k, cast(substr(lpad(whole, 36, '0'), k * 3 + 1, 3) AS INTEGER) AS num
       FROM ep, range(12) r(k) WHERE length(whole) <= 36),
er AS (SELECT g.token, string_agg(v.said || {sql_list(fixed.EN_SCALES)}[12 - k], ' ' ORDER BY k) AS said
       FROM eg g JOIN e3 v ON v.num = g.num WHERE g.num > 0 GROUP BY g.token),
words_en AS (SELECT w.token, CASE WHEN dots > 1 OR length(whole) > 36 THEN NULL ELSE
       CASE WHEN whole = '' THEN 'zero' ELSE r.said END ||
       CASE WHEN frac <> '' THEN ' point ' || {spelled('frac', fixed.EN_DIGITS)} ELSE '' END END AS said
       FROM ep w LEFT JOIN er r ON r.token = w.token)"""


def replaced(name: str, source: str, pattern: str, words: str, said: str, where: str = "true") -> str:
    """CTEs that put ``said`` of table ``words`` for each match in the texts of ``source`` into table ``name``."""
    return f"""
{name}_t AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS i
   FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS toks FROM {source} WHERE {where}) x),
{name}_s AS (SELECT t.doc_id, list({said} ORDER BY i) AS said FROM {name}_t t LEFT JOIN {words} w ON w.token = t.token GROUP BY t.doc_id),
{name} AS (SELECT s.* EXCLUDE (text), CASE WHEN said IS NULL THEN text ELSE
   array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{pattern}'), said), lambda p: p[1] || coalesce(p[2], '')), '') END AS text
   FROM {source} s LEFT JOIN {name}_s r ON r.doc_id = s.doc_id)"""


def tokens_of(name: str, source: str, pattern: str, where: str = "true") -> str:
    return f"{name} AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{pattern}')) AS token FROM {source} WHERE {where})"


RICH = with_views("rich")


@query("strip_cjk", RICH + f"SELECT doc_id, {bare('text')} AS text FROM rich")
def _(v):
    return n.strip_cjk(v.rich, "text").select("doc_id", "text")


@query("pre_clean", RICH + f"SELECT doc_id, {cleaned('text')} AS text FROM rich")
def _(v):
    return n.pre_clean(v.rich, "text").select("doc_id", "text")


# The same with accents taken apart first, so that composition has work to do.
@query("pre_clean_decomposed", RICH + f"SELECT doc_id, {cleaned('text')} AS text FROM (SELECT doc_id, replace(replace(text, 'é', 'e' || chr(769)), ' the ', ' tho' || chr(795) || chr(777) || ' ') AS text FROM rich) r")
def _(v):
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit(" the "), F.lit(" tho\u031b\u0309 "))
    return n.pre_clean(v.rich.withColumn("text", apart), "text").select("doc_id", "text")


@query("ranges_to_words", RICH + f"SELECT doc_id, {ranged('text', 'đến')} AS vi, {ranged('text', 'to')} AS en FROM rich")
def _(v):
    both = v.rich.withColumn("vi", F.col("text")).withColumn("en", F.col("text"))
    return n.ranges_to_words(n.ranges_to_words(both, "vi", "đến"), "en", "to").select("doc_id", "vi", "en")


@query("vi_symbols", RICH + f"SELECT doc_id, {late(early('text'))} AS text FROM rich")
def _(v):
    return n.vi_symbols(v.rich, "text").select("doc_id", "text")


@query("en_symbols", RICH + f"SELECT doc_id, {english('text')} AS text FROM rich")
def _(v):
    return n.en_symbols(v.rich, "text").select("doc_id", "text")


@query("number_vocabulary", RICH + f""",
toks AS (SELECT unnest(regexp_extract_all(text, '{NUMBER}')) AS token FROM rich),
tokens AS (SELECT DISTINCT token FROM toks), {TRIPLETS}, {vi_words('tokens')}
SELECT t.token, count(*) AS n, any_value(w.said) AS words FROM toks t JOIN words_vi w ON w.token = t.token GROUP BY t.token""")
def _(v):
    return n.number_vocabulary(v.rich, "text", "vi")


@query("expand_numbers", RICH + f""", {tokens_of('tokens', 'rich', NUMBER)}, {TRIPLETS}, {vi_words('tokens')}, {en_words('tokens')},
{replaced('spoken_vi', 'rich', NUMBER, 'words_vi', "' ' || w.said || ' '")},
{replaced('spoken_en', 'rich', NUMBER, 'words_en', "coalesce(' ' || w.said || ' ', t.token)")}
SELECT v.doc_id, v.text AS vi, e.text AS en FROM spoken_vi v JOIN spoken_en e ON e.doc_id = v.doc_id""")
def _(v):
    both = v.rich.withColumn("vi", F.col("text")).withColumn("en", F.col("text"))
    return n.expand_numbers(n.expand_numbers(both, "vi", "vi"), "en", "en").select("doc_id", "vi", "en")


# RE2 has ASCII word boundaries only: an acronym needs a non-word neighbour of any script, so both are captured.
def acronyms(source: str, name: str, where: str = "true") -> str:
    table = "[" + ", ".join(f"'{fixed.VI_LETTERS[c]}'" for c in sorted(fixed.VI_LETTERS)) + "]"
    word = r"[\p{L}\p{N}_]+"
    said = (f"CASE WHEN regexp_full_match(t.token, '[A-Z]{{2,4}}') THEN "
            f"array_to_string(list_transform(string_split(t.token, ''), lambda c: {table}[ascii(c) - 64]), ' ') ELSE t.token END")
    return f"no_words AS (SELECT NULL::VARCHAR AS token)," + replaced(name, source, word, "no_words", said, where)


@query("spell_acronyms", RICH + f", {acronyms('rich', 'spoken')} SELECT doc_id, text FROM spoken")
def _(v):
    return n.spell_acronyms(v.rich, "text").select("doc_id", "text")


# Phone numbers are walked from left to right: one step reads the text up to the next one.
PHONE = rf"(?s)^(|.*?[^\p{{Nd}}])(\+?{D}[{D} \-]{{7,12}}{D})(?:[^\p{{Nd}}]|$)"


def phones(name: str, source: str) -> str:
    digits = "regexp_replace(m.tok, '[^0-9]', '', 'g')"
    is_phone = f"length({digits}) >= 10 OR length({digits}) = 9 AND ({digits}[1] = '0' OR m.tok[1] = '+')"
    return f"""
{name}_w AS (
  SELECT doc_id, '' AS done, text AS rest, 0 AS n FROM {source}
  UNION ALL
  SELECT doc_id, done || m.pre || CASE WHEN {is_phone} THEN ' ' || {spelled(digits, fixed.VI_DIGITS)} || ' ' ELSE m.tok END,
         substr(rest, length(m.pre) + length(m.tok) + 1), n + CASE WHEN {is_phone} THEN 1 ELSE 0 END
  FROM (SELECT *, regexp_extract(rest, '{PHONE}', ['pre', 'tok']) AS m FROM {name}_w) w WHERE m.tok <> ''),
{name} AS (SELECT s.* EXCLUDE (text), done || rest AS text, n AS phones FROM {source} s JOIN {name}_w w ON w.doc_id = s.doc_id
           WHERE NOT regexp_matches(rest, '{PHONE}'))"""


@query("spell_phones", RICH.replace("WITH", "WITH RECURSIVE", 1) + f", {phones('spoken', 'rich')} SELECT doc_id, text FROM spoken")
def _(v):
    return n.spell_phones(v.rich, "text").select("doc_id", "text")


_LANGS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Tiếng Việt' WHEN 1 THEN 'English' WHEN 2 THEN '日本語' WHEN 3 THEN 'Português (Brasil)'
    WHEN 4 THEN 'English (US)' WHEN 5 THEN '한국어' WHEN 6 THEN 'Français' WHEN 7 THEN NULL ELSE lang END AS target FROM docs"""


@query("lang_code", with_views("docs") + f""", named AS ({_LANGS}),
codes AS (SELECT unnest({sql_list(list(fixed.LANGUAGE_CODES))}) AS name, unnest({sql_list(list(fixed.LANGUAGE_CODES.values()))}) AS code)
SELECT doc_id, target, coalesce(code, '') AS lang_code, code IS NULL AS is_unmapped FROM named LEFT JOIN codes ON name = lower(target)""")
def _(v):
    return n.lang_code(v.sql(_LANGS, "docs"), "target")


@query("ref_text_cap", with_views("segments") + f""",
w AS (SELECT job_id, seq, regexp_replace(original_text, {TRIM}) AS text, end_time - start_time AS dur,
      regexp_split_to_array(regexp_replace(original_text, {TRIM}), '{SPACE}+') AS words FROM segments)
SELECT job_id, seq, CASE WHEN dur > 10 THEN array_to_string(words[1:greatest(1, round_even(len(words) * 10::DOUBLE / dur, 0)::BIGINT)], ' ')
       ELSE text END AS ref_text FROM w""")
def _(v):
    return n.ref_text_cap(v.segments, col="original_text").select("job_id", "seq", "ref_text")


_SPOKEN = "SELECT doc_id, text, CASE lang WHEN 'de' THEN 'vi' WHEN 'es' THEN 'vi' ELSE lang END AS lang FROM rich"


_TWICE = [(rf"(?i)(^|[^\p{{L}}\p{{N}}_])({w}){SPACE}+{w}([^\p{{L}}\p{{N}}_]|$)", r"\1\2\3") for w in ("ngày", "tháng", "năm", "giờ")]


@query("normalize_corpus", RICH.replace("WITH", "WITH RECURSIVE", 1) + f""", spoken AS ({_SPOKEN}),
clean AS (SELECT doc_id, lang, {cleaned('text')} AS text FROM spoken),
script AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{WRONG_SCRIPT}') THEN {bare('text')} ELSE text END AS text FROM clean WHERE lang = 'vi'),
{phones('dialled', 'script')},
ready AS (SELECT doc_id, {late(ranged(early('text'), 'đến'))} AS text FROM dialled),
ready_en AS (SELECT doc_id, {english(ranged('text', 'to'))} AS text FROM clean WHERE lang = 'en'),
{tokens_of('tokens', 'ready', NUMBER)}, {tokens_of('tokens_en', 'ready_en', NUMBER)},
{TRIPLETS}, {vi_words('tokens')}, {en_words('tokens_en')},
{replaced('numbered', 'ready', NUMBER, 'words_vi', "' ' || w.said || ' '")},
{replaced('numbered_en', 'ready_en', NUMBER, 'words_en', "coalesce(' ' || w.said || ' ', t.token)")},
{acronyms('numbered', 'lettered')}
SELECT doc_id, 'vi' AS lang, {squeezed(sub(squeezed('text'), *_TWICE))} AS text FROM lettered
UNION ALL SELECT doc_id, 'en', {squeezed('text')} FROM numbered_en
UNION ALL SELECT doc_id, lang, text FROM clean WHERE lang NOT IN ('vi', 'en')""")
def _(v):
    return normalize_corpus(v.sql(_SPOKEN, "rich"), "text", "lang").select("doc_id", "lang", "text")


# Digits do not touch letters after the first step, so for the languages that are only cleaned and for English SQL can say it all.
@query("normalize_corpus_en", RICH + f""",
ready AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN {english(ranged(cleaned('text'), 'to'))} ELSE {cleaned('text')} END AS text FROM rich),
{tokens_of('tokens', 'ready', NUMBER, "lang = 'en'")}, {TRIPLETS}, {en_words('tokens')},
{replaced('spoken', 'ready', NUMBER, 'words_en', "coalesce(' ' || w.said || ' ', t.token)", "lang = 'en'")}
SELECT doc_id, lang, CASE WHEN lang = 'en' THEN {squeezed('text')} ELSE text END AS text FROM spoken""")
def _(v):
    return normalize_corpus(v.rich, "text", "lang").select("doc_id", "lang", "text")


@query("normalize_hits", RICH.replace("WITH", "WITH RECURSIVE", 1) + f""", spoken AS ({_SPOKEN}),
clean AS (SELECT doc_id, lang, {cleaned('text')} AS text FROM spoken),
script AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{WRONG_SCRIPT}') THEN {bare('text')} ELSE text END AS text FROM clean WHERE lang = 'vi'),
{phones('dialled', 'script')},
ready AS (SELECT doc_id, {late(ranged(early('text'), 'đến'))} AS text FROM dialled),
ready_en AS (SELECT doc_id, {english(ranged('text', 'to'))} AS text FROM clean WHERE lang = 'en'),
{tokens_of('tokens', 'ready', NUMBER)}, {tokens_of('tokens_en', 'ready_en', NUMBER)},
{TRIPLETS}, {vi_words('tokens')}, {en_words('tokens_en')},
{replaced('numbered', 'ready', NUMBER, 'words_vi', "' ' || w.said || ' '")},
said_en AS (SELECT count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{NUMBER}')) AS token FROM ready_en) t JOIN words_en w ON w.token = t.token WHERE w.said IS NOT NULL),
hits AS (
  SELECT lang, 'addresses' AS rule, sum(len(regexp_extract_all(nfc_normalize(text), '{ADDRESS}'))) AS n FROM spoken GROUP BY lang
  UNION ALL SELECT lang, 'script', sum(len(regexp_extract_all(text, '{WRONG_SCRIPT}'))) FROM clean WHERE lang = 'vi' GROUP BY lang
  UNION ALL SELECT 'vi', 'phones', sum(phones) FROM dialled
  UNION ALL SELECT 'vi', 'percent', sum(len(regexp_extract_all({ranged(early('text'), 'đến')}, '{D}{SPACE}*%'))) FROM dialled
  UNION ALL SELECT lang, 'percent', sum(len(regexp_extract_all({ranged('text', 'to')}, '{D}{SPACE}*%'))) FROM clean WHERE lang = 'en' GROUP BY lang
  UNION ALL SELECT 'vi', 'numbers', sum(len(regexp_extract_all(text, '{NUMBER}'))) FROM ready
  UNION ALL SELECT 'en', 'numbers', n FROM said_en
  UNION ALL SELECT 'vi', 'acronyms', sum(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,4}}')))) FROM numbered)
SELECT t.*, h.* EXCLUDE (lang) FROM (SELECT lang, count(*) AS texts FROM spoken GROUP BY lang) t JOIN
  (SELECT lang, {', '.join(f"sum(CASE WHEN rule = '{r}' THEN n ELSE 0 END)::BIGINT AS hit_{r}" for r in RULES)} FROM hits GROUP BY lang) h ON h.lang = t.lang""")
def _(v):
    return hit_report(normalize_corpus(v.sql(_SPOKEN, "rich"), "text", "lang"), "lang")
