"""SQL for DuckDB that computes the registered queries independently, with patterns of its own.

Only fixed texts are shared: templates, stop words and the lexicon of the queries.
"""

from __future__ import annotations

from textloom.checks.queries import LEXICON
from textloom.functions.insights import STOP_WORDS
from textloom.functions.prompts import FALLBACK
from textloom.operators.prompting import DEFAULT_TEMPLATES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The characters that Unicode and ASCII count as white space.
_BLANKS = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_SPACE = quote("".join(map(chr, _BLANKS)))
_SPACES = quote("[" + "".join(rf"\x{{{c:x}}}" for c in _BLANKS) + "]+")
_PUNCT = quote("!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~")
# An address has an @ between a run of its characters and names with full stops; the last name is letters.
_MAIL = r"[A-Z0-9a-z%_.+-]+@(?:[0-9A-Za-z-]+[.])+[A-Za-z][A-Za-z]+"
_DAY = r"\d{4}-\d\d-\d\d"
_CALL = r"(?:[+]\d{1,3}[-. ]?)?(?:[(]\d{3}[)] ?|\d{3}[-. ])\d{3}[-. ]\d{4}"
_PII, _DATE = quote(f"{_MAIL}|{_DAY}|{_CALL}"), quote(_DAY)
_STOP = "[" + ", ".join(map(quote, STOP_WORDS)) + "]"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(trim({text}, {_SPACE}), {_SPACES}), lambda w: w <> '')"


# Pages

_SILENT = ("script", "style", "template", "rt", "rp", "head")
_MARKUP = quote(
    r"(?is)<!--.*?(?:-->|\z)|"
    + "|".join(rf"<{n}(?:[\s/][^>]*)?>.*?(?:</{n}\s*>|\z)" for n in _SILENT)
    + r"""|<[a-z/!?][^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?[^>=]*)*(?:>|\z)"""
)
_BODY = """CASE WHEN instr(html, '<body') = 0 THEN ''
  WHEN instr(html, '</body>') = 0 THEN substr(html, instr(html, '<body'), length(html) - instr(html, '<body'))
  WHEN instr(html, '</body>') <= instr(html, '<body') THEN ''
  ELSE substr(html, instr(html, '<body'), instr(html, '</body>') - instr(html, '<body')) END"""


def _decoded(text: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


def _text_of(html: str) -> str:
    nodes = f"list_transform(string_split_regex({html}, {_MARKUP}), lambda n: trim({_decoded('n')}, {_SPACE}))"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), ' ')"


_PAGE_TEXT = f"SELECT page_id, {_text_of('body')} AS text FROM (SELECT page_id, {_BODY} AS body FROM pages)"
_FROM_BODY = "CASE WHEN regexp_matches(html, '(?i)<body[\\s/>]') THEN substr(html, instr(lower(html), '<body')) ELSE html END"

# Routing

_MADE = """SELECT page_id, unnest([url, 's3://pages/' || page_id || '.pdf', 'quip://' || page_id,
  '/in/' || page_id || '.mp3', '/in/' || page_id || '.pdf', '/in/' || page_id || '.docx',
  '/in/' || page_id || '.xlsx', '/in/' || page_id || '.PNG', '/in/' || page_id || '.png',
  '/in/' || page_id || '.json', 'https://youtu.be/' || page_id]) AS path FROM pages"""
_ROUTE = f"""SELECT page_id, path, CASE
  WHEN contains(path, 'youtube') OR contains(path, 'youtu.be') THEN 'youtube_url'
  WHEN starts_with(path, 'http') THEN 'http' WHEN starts_with(path, 's3://') THEN 's3'
  WHEN starts_with(path, 'quip://') THEN 'quip'
  WHEN regexp_matches(path, '\\.(mp3|mp4|m4a|wav|flac|mov|avi)\\z') THEN 'multimedia_file'
  WHEN ends_with(path, '.pdf') THEN 'pdf' WHEN ends_with(path, '.docx') THEN 'microsoft_word'
  WHEN regexp_matches(path, '\\.(xlsx|xlsm|xltx|xltm)\\z') THEN 'microsoft_excel'
  WHEN regexp_matches(path, '\\.(jpg|jpeg|png|tiff)\\z') THEN 'image_file'
  ELSE 'text_or_json' END AS input_type FROM ({_MADE})"""
_READ = """CASE input_type WHEN 'youtube_url' THEN 'read_video>upload>transcribe>write_text'
  WHEN 'multimedia_file' THEN 'upload>transcribe>write_text' WHEN 'image_file' THEN 'read_text>ocr'
  WHEN 'pdf' THEN 'read_pdf' WHEN 'http' THEN 'fetch_page>html_to_text>write_text'
  WHEN 'text_or_json' THEN 'read_text' WHEN 's3' THEN 'read_object' WHEN 'quip' THEN 'read_thread>html_to_text'
  WHEN 'microsoft_word' THEN 'read_word' WHEN 'microsoft_excel' THEN 'read_sheet' END"""
_EVEN, _THIRD = "page_id % 2 = 0", "page_id % 3 = 0"


def _plan(summary_first: str) -> str:
    return f"""{_READ} || CASE WHEN {_EVEN} THEN '>tokenize' ELSE '' END
  || CASE page_id % 4 WHEN 0 THEN '>fill_prompt>call_model' WHEN 1 THEN {summary_first}
     WHEN 2 THEN '>chat>fill_prompt>call_model' ELSE '>chat' END
  || CASE WHEN {_EVEN} THEN '>restore' ELSE '' END || CASE WHEN {_THIRD} THEN '>clipboard' ELSE '' END"""


_ALL_THREE = "'>fill_prompt>call_model>chat'"
_CUT = f"CASE WHEN {_EVEN} OR {_THIRD} THEN '>fill_prompt' ELSE {_ALL_THREE} END"

# Personal data

_TYPE = f"CASE WHEN contains(value, '@') THEN 'EMAIL' WHEN regexp_full_match(value, {_DATE}) THEN 'DATE' ELSE 'PHONE' END"


def _matches(source: str = "documents") -> str:
    return f"""gaps AS (SELECT doc_id, text, ms,
    CASE WHEN len(ms) = 0 THEN [text] ELSE string_split_regex(text, {_PII}) END AS gs
  FROM (SELECT doc_id, text, regexp_extract_all(text, {_PII}) AS ms FROM {source})),
matches AS (SELECT doc_id, k, gs, ms, ms[k] AS value FROM (SELECT doc_id, gs, ms, unnest(range(1, len(ms) + 1)) AS k FROM gaps)),
tokens AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY seen) AS n, 'T' || n AS token
  FROM (SELECT doc_id, value, min(k) AS seen FROM matches GROUP BY doc_id, value))"""


def _token_map(source: str = "documents") -> str:
    return f"WITH {_matches(source)} SELECT doc_id, token, value, {_TYPE} AS type FROM tokens"


def _tokenized(source: str = "documents") -> str:
    return f"""WITH {_matches(source)},
parts AS (SELECT doc_id, ms, gs, unnest(range(1, len(gs) + 1)) AS k FROM gaps)
SELECT p.doc_id, string_agg(p.gs[p.k] || coalesce(t.token, ''), '' ORDER BY p.k) AS text
FROM parts p LEFT JOIN tokens t ON t.doc_id = p.doc_id AND t.value = p.ms[p.k] GROUP BY p.doc_id"""


_MATCHES, _TOKEN_MAP, _TOKENIZED = _matches(), _token_map(), _tokenized()
_LETTERS = """(SELECT c.c_custkey AS doc_id, CASE WHEN listed IS NULL THEN 'No order of ' || c.c_custkey
  ELSE format('Write to {0}. Call +1 (555) 01{1}-{2}: {3}; again {0}.',
    'customer.' || c.c_custkey || '@mail.shop.' || c.c_custkey || '.a.b.c.d.e.f.g.example.com', c.c_custkey % 10,
    lpad((c.c_custkey % 10000)::VARCHAR, 4, '0'), listed) END AS text
  FROM customer c LEFT JOIN (SELECT o_custkey,
      string_agg('order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d'), ', ' ORDER BY o_orderkey) AS listed
    FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""
_IN_ORDER = f"""WITH t AS ({_tokenized(_LETTERS)}),
m AS (SELECT doc_id, list([token, value] ORDER BY substr(token, 2)::INT) AS ms FROM ({_token_map(_LETTERS)}) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN ms IS NULL THEN text
  ELSE list_reduce(list_prepend([text, ''], ms), lambda a, b: [replace(a[1], b[1], b[2]), ''])[1] END AS text
FROM t LEFT JOIN m ON m.doc_id = t.doc_id"""
_PHRASED = f"""WITH texts AS (SELECT p_partkey AS doc_id,
    'We sell (' || p_name || '), ' || p_brand || ' and more ' || p_name || 's by ' || p_type || '.' AS text FROM part),
known AS (SELECT DISTINCT p_name AS name, len(string_split(p_name, ' ')) AS n FROM part),
ws AS (SELECT doc_id, {_words('text')} AS ws FROM texts),
grams AS (SELECT DISTINCT doc_id, trim(array_to_string(ws[i:i + n - 1], ' '), {_PUNCT}) AS name
  FROM ws, (SELECT DISTINCT n FROM known) k, generate_series(1, len(ws) - n + 1) g(i)),
orgs AS (SELECT doc_id, list(name ORDER BY length(name) DESC, name) AS names FROM grams JOIN known USING (name) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN names IS NULL THEN text
  ELSE list_reduce(list_prepend(text, names), lambda t, n: replace(t, n, '[Customer]')) END AS text
FROM texts t LEFT JOIN orgs ON orgs.doc_id = t.doc_id"""
_GAZETTEER = f"""listed AS (SELECT {_words('text')} AS ws FROM benchmark),
gazetteer AS (SELECT name, min(type) AS type FROM (
    SELECT trim(ws[1], {_PUNCT}) AS name, 'ORG' AS type FROM listed
    UNION ALL SELECT trim(ws[len(ws)], {_PUNCT}), 'NAME' FROM listed) WHERE name <> '' GROUP BY name),
found AS (SELECT d.doc_id, g.name, g.type, min(d.i) AS seen FROM (
    SELECT doc_id, i, trim(ws[i], {_PUNCT}) AS name FROM (
      SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, {_words('text')} AS ws FROM documents))) d
  JOIN gazetteer g ON g.name = d.name GROUP BY ALL)"""

# The leftmost longest phrase at each word; then from one to the first that starts after its end.
_PHRASE_HITS = f"""listed AS (SELECT {_words('text')} AS ws FROM benchmark),
phrases AS (SELECT name, min(type) AS type FROM (
    SELECT trim(array_to_string(ws[i:i + n - 1], ' '), ' ' || {_PUNCT}) AS name, CASE n WHEN 2 THEN 'NAME' ELSE 'ORG' END AS type
    FROM listed, (VALUES (2), (3)) l(n), generate_series(1, len(ws) - n + 1) g(i)) WHERE name <> '' GROUP BY name),
told AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
hits AS MATERIALIZED (SELECT doc_id, i, max(n) AS n, arg_max(name, n) AS name, arg_max(type, n) AS type FROM (
    SELECT doc_id, i, n, trim(array_to_string(ws[i:i + n - 1], ' '), {_PUNCT}) AS name
    FROM told, (VALUES (1), (2), (3)) l(n), generate_series(1, len(ws) - n + 1) g(i)) JOIN phrases USING (name) GROUP BY doc_id, i),
linked AS MATERIALIZED (SELECT a.doc_id, a.i, b.i AS after FROM hits a ASOF LEFT JOIN hits b ON a.doc_id = b.doc_id AND a.i + a.n <= b.i),
taken(doc_id, i) AS (SELECT doc_id, min(i) FROM hits GROUP BY doc_id
  UNION ALL SELECT l.doc_id, l.after FROM taken t JOIN linked l ON l.doc_id = t.doc_id AND l.i = t.i WHERE l.after IS NOT NULL)"""

# Chunks

_CHUNKS = f"""ws AS MATERIALIZED (SELECT doc_id, {_words('text')} AS ws FROM documents),
sums AS MATERIALIZED (SELECT doc_id, i, sum(size) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS total
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(ws, lambda w: strlen(w))) AS size FROM ws)),
cut(doc_id, chunk_no, s, e, used) AS (
  SELECT doc_id, 0, 0::BIGINT, count(*) FILTER (total <= 4000), coalesce(max(total) FILTER (total <= 4000), 0)
  FROM sums GROUP BY doc_id
  UNION ALL
  SELECT doc_id, chunk_no + 1, e, greatest(max(i) FILTER (total <= used + 4000), min(i)),
    greatest(max(total) FILTER (total <= used + 4000), min(total))
  FROM (SELECT cut.doc_id, chunk_no, e, used, i, total FROM cut JOIN sums ON sums.doc_id = cut.doc_id AND sums.i > cut.e)
  GROUP BY doc_id, chunk_no, e),
chunks AS (SELECT cut.doc_id, chunk_no, array_to_string(ws[s + 1:e], ' ') AS chunk FROM cut JOIN ws ON ws.doc_id = cut.doc_id)"""
_LEXICON = ", ".join(f"({quote(word)}, {weight})" for word, weight in LEXICON.items())
_LABELS = f"""{_CHUNKS},
lexicon(word, weight) AS (VALUES {_LEXICON}),
tokens AS (SELECT doc_id, chunk_no, unnest(list_transform({_words('lower(chunk)')}, lambda w: trim(w, {_PUNCT}))) AS word FROM chunks),
sided AS (SELECT doc_id, chunk_no, sum(greatest(weight, 0)) AS plus, sum(greatest(-weight, 0)) AS minus
  FROM tokens JOIN lexicon USING (word) GROUP BY ALL),
labels_of AS (SELECT c.doc_id, c.chunk_no, CASE
    WHEN plus > 0 AND minus > 0 AND abs(plus - minus) * 4 <= plus + minus THEN 'MIXED'
    WHEN plus > minus THEN 'POSITIVE' WHEN minus > plus THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
  FROM chunks c LEFT JOIN sided s ON s.doc_id = c.doc_id AND s.chunk_no = c.chunk_no)"""
_VOTE = """voted AS (SELECT doc_id, label AS sentiment FROM (
    SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, label) AS rank
    FROM labels_of GROUP BY doc_id, label) WHERE rank = 1)"""
_PIECE = f"""CASE WHEN trim(w, {_PUNCT}) = '' OR list_contains({_STOP}, trim(w, {_PUNCT})) THEN chr(1)
  ELSE CASE WHEN starts_with(w, trim(w, {_PUNCT})) THEN '' ELSE chr(1) END || trim(w, {_PUNCT})
    || CASE WHEN ends_with(w, trim(w, {_PUNCT})) THEN '' ELSE chr(1) END END"""
_PHRASES = f"""said AS (SELECT doc_id, chunk_no, trim(unnest(string_split(array_to_string(
    list_transform({_words('lower(chunk)')}, lambda w: {_PIECE}), ' '), chr(1)))) AS phrase FROM chunks),
scored AS (SELECT doc_id, chunk_no, phrase, (count(*) * len(string_split(phrase, ' ')))::DOUBLE AS score
  FROM said WHERE phrase <> '' GROUP BY doc_id, chunk_no, phrase),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY score DESC, phrase) - 1)::INTEGER AS rank FROM scored)"""
_ENTITIES = f"""entity_list AS (SELECT doc_id, chunk_no, regexp_extract_all(chunk, {_PII}) AS ms FROM chunks),
entity AS (SELECT doc_id, chunk_no, (pos - 1)::INTEGER AS pos, value, {_TYPE} AS type FROM (
    SELECT doc_id, chunk_no, pos, ms[pos] AS value FROM (
      SELECT doc_id, chunk_no, ms, unnest(range(1, len(ms) + 1)) AS pos FROM entity_list)))"""
_TOP_PHRASES = f"""WITH RECURSIVE {_CHUNKS}, {_PHRASES},
p AS (SELECT doc_id, string_agg(phrase || '=' || score::BIGINT, ',' ORDER BY chunk_no, rank) AS key_phrases
  FROM ranked WHERE rank < 5 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN len(ws) > 0 THEN coalesce(key_phrases, '') END AS key_phrases
FROM ws d LEFT JOIN p ON p.doc_id = d.doc_id"""
_INSIGHTS = f"""WITH RECURSIVE {_LABELS}, {_VOTE}, {_PHRASES}, {_ENTITIES},
p AS (SELECT doc_id, string_agg(phrase || '=' || score::BIGINT, ',' ORDER BY chunk_no, rank) AS key_phrases
  FROM ranked GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(type || '=' || value, ',' ORDER BY chunk_no, pos) AS entities FROM entity GROUP BY doc_id)
SELECT d.doc_id, v.sentiment, CASE WHEN v.doc_id IS NOT NULL THEN coalesce(e.entities, '') END AS entities,
  CASE WHEN v.doc_id IS NOT NULL THEN coalesce(p.key_phrases, '') END AS key_phrases
FROM documents d LEFT JOIN voted v ON v.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = v.doc_id LEFT JOIN e ON e.doc_id = v.doc_id"""

# Prompts


def _prompt(template: str, text: str) -> str:
    before, after = template.split("{input_text}")
    return f"{quote(before)} || {text} || {quote(after)}"


_DEFAULT = DEFAULT_TEMPLATES["default_prompt"]
_BODIES = """SELECT doc_id,
  json_object('max_tokens', 4096, 'messages', json_array(json_object('role', 'user', 'content', text)))::VARCHAR AS chat_body,
  json_object('prompt', chr(10) || chr(10) || 'Human:' || text || chr(10) || chr(10) || 'Assistant:',
    'max_tokens_to_sample', 4096, 'temperature', 0.5::DOUBLE, 'stop_sequences', json_array())::VARCHAR AS completion_body,
  json_object('inputText', chr(10) || text, 'config', json_object('maxTokenCount', 4096, 'topP', 1))::VARCHAR AS nested_body
FROM documents"""
_RESPONSES = """SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'fr' THEN json_object('completion', text)::VARCHAR END AS text
FROM documents"""
_SUMMARY = rf"""WITH split AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s, {_SPACE})),
    lambda s: s <> '') AS ss FROM documents),
sent AS (SELECT doc_id, no, ss[no] AS s FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS no FROM split)),
occ AS (SELECT doc_id, no, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) AS word FROM sent),
tf AS (SELECT doc_id, word, count(*) AS n FROM occ GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS docs FROM tf GROUP BY word),
idf AS (SELECT word, round(ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (docs + 1)) * 1000000)::BIGINT AS idf FROM df),
score AS (SELECT o.doc_id, o.no, sum(tf.n * idf.idf) / count(*)::DOUBLE AS mean
  FROM occ o JOIN tf ON tf.doc_id = o.doc_id AND tf.word = o.word JOIN idf ON idf.word = o.word GROUP BY ALL),
best AS (SELECT doc_id, no, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, no) AS rank FROM score),
picked AS (SELECT b.doc_id, string_agg(sent.s, ' ' ORDER BY b.no) AS summary
  FROM best b JOIN sent ON sent.doc_id = b.doc_id AND sent.no = b.no WHERE rank <= 3 GROUP BY b.doc_id)
SELECT d.doc_id, coalesce(p.summary, '') AS summary FROM documents d LEFT JOIN picked p ON p.doc_id = d.doc_id"""

# Conversations

_HISTORY = """SELECT conv_id, turn, role, list(json_object('role', role, 'content', text)::VARCHAR)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ms
  FROM conversations"""
_MESSAGES = "'{\"messages\":[' || array_to_string(ms, ',') || ']}'"

# Glossaries: the categories and terms that each valid form of the text holds.

_GLOSSARY = """WITH p AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE p_size % 5 END AS form FROM part)
SELECT p_partkey AS doc_id, 0 AS category_no, p_brand AS category, 0 AS term_no, p_name AS name, p_type AS "shortDescription"
  FROM p WHERE form = 0
UNION ALL SELECT p_partkey, 0, p_brand, 1, p_brand, p_name FROM p WHERE form = 0
UNION ALL SELECT p_partkey, 0, p_type, 0, p_name, p_type FROM p WHERE form = 1
UNION ALL SELECT p_partkey, 1, p_brand, 0, p_brand, p_name FROM p WHERE form = 1
UNION ALL SELECT p_partkey, 0, p_brand, 0, p_brand, p_name FROM p WHERE form = 5
UNION ALL SELECT p_partkey, 1, p_type, 0, p_name, p_type FROM p WHERE form = 5"""
_CATALOG = f"""SELECT CASE WHEN known THEN 'type-' || name ELSE 'glossary-' || md5(name) END AS id, name,
  CASE WHEN NOT known THEN 'Glossary for ' || name END AS description,
  CASE WHEN NOT known THEN 'ENABLED' END AS status, NOT known AS created
FROM (SELECT name, name IN (SELECT p_type FROM part) AS known FROM (SELECT DISTINCT category AS name FROM ({_GLOSSARY})))"""

_PLACED = f"""SELECT c.id AS glossary_id, t.category, t.name, t."shortDescription", 'ENABLED' AS status
FROM ({_GLOSSARY}) t JOIN ({_CATALOG}) c ON c.name = t.category"""
_SHEETS = """SELECT o_custkey AS doc_id, string_agg(o_orderkey || ' '
  || CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus || ' ' ELSE '' END
  || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority || ' ' || chr(10), '' ORDER BY o_orderkey) AS text
FROM orders GROUP BY o_custkey"""

_FILES = """SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines,
  sum(length(text) + 1)::BIGINT AS n_chars FROM documents GROUP BY source"""

_FORM = "replace(url_encode({}), '%20', '+')"

def _talk(text: str) -> str:
    """History of a chat about a text: as many questions as page_id % 3, answers that count the messages."""
    return f"""CASE WHEN page_id % 5 = 0 THEN {text} ELSE '{{"messages":[{{"role":"user","content":' || to_json({text}) || '}}'
  || array_to_string([',{{"role":"user","content":' || to_json('Question ' || i || ' on ' || url) || '}},{{"role":"assistant","content":"Answer to '
    || 2 * i || '"}}' FOR i IN range(1, page_id % 3 + 1)], '') || ']}}' END"""


def _asked(text: str) -> str:
    return f"nullif(CASE WHEN page_id % 7 = 0 THEN {_prompt(FALLBACK, text)} ELSE {_prompt(_DEFAULT, text)} END, '')"


_ROUTED = f"""WITH kinds AS ({_ROUTE}),
read AS (SELECT k.page_id, k.path, p.url, coalesce(CASE k.input_type WHEN 'http' THEN once.text WHEN 'quip' THEN twice.text ELSE p.html END, '') AS t
  FROM kinds k JOIN pages p ON p.page_id = k.page_id
  LEFT JOIN ({_PAGE_TEXT}) once ON once.page_id = k.page_id
  LEFT JOIN (SELECT page_id, {_text_of('once')} AS text FROM (SELECT page_id, {_text_of('body')} AS once
    FROM (SELECT page_id, {_FROM_BODY} AS body FROM pages))) twice ON twice.page_id = k.page_id)
SELECT page_id, path, CASE length(path) % 4 WHEN 0 THEN {_asked('t')} WHEN 1 THEN {_talk('answer')} WHEN 2 THEN {_asked('talk')} ELSE talk END AS text,
  NULL::VARCHAR AS error
FROM (SELECT *, {_talk('t')} AS talk, {_asked('t')} AS answer FROM read)"""


ORACLE: dict[str, str] = {
    "html_body": f"SELECT page_id, {_BODY} AS body FROM pages",
    "html_text": _PAGE_TEXT,
    "thread_text": f"""SELECT page_id::VARCHAR AS thread, {_text_of('once')} AS text
FROM (SELECT page_id, {_text_of('body')} AS once FROM (SELECT page_id, {_FROM_BODY} AS body FROM pages))""",
    "transcripts": "SELECT doc_id, text FROM documents",
    "upload_paths": "SELECT page_id, 's3://bucket/uploads/' || string_split(url, '/')[-1] AS path FROM pages",
    "s3_paths": "SELECT doc_id, source AS bucket, lang || '/' || doc_id AS key FROM documents",
    "form_payload": f"""SELECT doc_id, 'content=' || {_FORM.format('text')} || '&format=html&member_ids='
  || {_FORM.format('source')} || '&type=document' AS payload FROM documents""",
    "route": _ROUTE,
    "route_plan": f"SELECT path, page_id, {_plan(_ALL_THREE)} AS stages, {_plan(_CUT)} AS compat_stages FROM ({_ROUTE})",
    "request_records": f"""SELECT page_id, path, input_type, 'default_prompt' AS prompt_name, '' AS text,
  NULL::VARCHAR AS error FROM ({_ROUTE})""",
    "pii_spans": f"""WITH {_MATCHES}
SELECT doc_id, ("end" - length(value))::INTEGER AS begin, "end"::INTEGER AS "end", {_TYPE} AS type, value FROM (
  SELECT doc_id, value, list_sum(list_transform(gs[1:k], lambda g: length(g)))
    + list_sum(list_transform(ms[1:k], lambda m: length(m))) AS "end" FROM matches)""",
    "pii_token_map": _TOKEN_MAP,
    "pii_token_map_spans": _TOKEN_MAP,
    "pii_tokenized": _TOKENIZED,
    "pii_tokenized_spans": _TOKENIZED,
    "stream_tokenized": _TOKENIZED,
    "pii_roundtrip": "SELECT doc_id, text, true AS reversible FROM documents",
    "pii_restored_table": f"""SELECT doc_id, text,
  CASE WHEN NOT regexp_matches(text, {_PII}) THEN 'token map is missing' END AS error FROM documents""",
    "pii_customers": _tokenized(_LETTERS),
    "pii_customer_map": _token_map(_LETTERS),
    "stream_restored": f"""SELECT d.doc_id, CASE WHEN lost THEN t.text ELSE d.text END AS text,
  CASE WHEN lost THEN 'quarantine' ELSE 'restored' END AS state, CASE WHEN lost THEN 'token map is missing' END AS error
FROM documents d JOIN (SELECT doc_id, text FROM ({_TOKENIZED})) t USING (doc_id), LATERAL (SELECT
  regexp_matches(t.text, 'T[0-9]') AND (d.doc_id % 7 = 0 OR NOT regexp_matches(d.text, {_PII})) AS lost)""",
    "stored_token_map": f"""SELECT doc_id, text,
  CASE WHEN starts_with(text, 'No order') THEN 'token map is missing' END AS error FROM {_LETTERS}""",
    "restored_in_order": _IN_ORDER,
    "org_phrases": _PHRASED,
    "org_phrases_joined": _PHRASED,
    "gazetteer_names": f"""WITH {_GAZETTEER}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seen) - 1)::INTEGER AS pos, name, type FROM found""",
    "trie_names": f"""WITH RECURSIVE {_PHRASE_HITS}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, name, type
FROM taken JOIN hits USING (doc_id, i)""",
    "org_anonymized": f"""WITH {_GAZETTEER},
orgs AS (SELECT doc_id, list(name ORDER BY length(name) DESC, name) AS names FROM found WHERE type = 'ORG' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN names IS NULL THEN text
  ELSE list_reduce(list_prepend(text, names), lambda t, n: replace(t, n, '[Customer]')) END AS text
FROM documents d LEFT JOIN orgs ON orgs.doc_id = d.doc_id""",
    "chunks": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_no, chunk FROM chunks",
    "chunk_sizes": f"""WITH RECURSIVE {_CHUNKS} SELECT d.doc_id, count(chunk_no)::INTEGER AS n_chunks,
  coalesce(sum(length(chunk)), 0)::INTEGER AS n_chars FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
    "chunk_labels": f"WITH RECURSIVE {_LABELS} SELECT doc_id, chunk_no, label FROM labels_of",
    "chunk_labels_joined": f"WITH RECURSIVE {_LABELS} SELECT doc_id, chunk_no, label FROM labels_of",
    "doc_sentiment": f"WITH RECURSIVE {_LABELS}, {_VOTE} SELECT doc_id, sentiment FROM voted",
    "chunk_key_phrases": f"""WITH RECURSIVE {_CHUNKS}, {_PHRASES}
SELECT doc_id, chunk_no, rank, phrase, score AS "Score" FROM ranked""",
    "chunk_entities": f"""WITH RECURSIVE {_CHUNKS}, {_ENTITIES}
SELECT doc_id, chunk_no, pos, value AS "Text", type AS "Type", 1.0::DOUBLE AS "Score" FROM entity""",
    "doc_insights": _INSIGHTS,
    "doc_insights_merged": _INSIGHTS,
    "stream_insights": _INSIGHTS,
    "top_phrases": _TOP_PHRASES,
    "prompt_default": f"SELECT doc_id, {_prompt(_DEFAULT, 'text')} AS prompt FROM documents",
    "prompt_fallback": f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_prompt(_DEFAULT, 'text')}
  ELSE {_prompt(FALLBACK, 'text')} END AS prompt,
  CASE WHEN doc_id % 2 = 0 THEN 'default_prompt' ELSE 'missing' END AS prompt_name FROM documents""",
    "request_bodies": _BODIES,
    "response_text": _RESPONSES,
    "reply_paths": """SELECT doc_id,
  CASE k WHEN 4 THEN NULL WHEN 0 THEN t ELSE 'whole' END AS each, CASE k WHEN 4 THEN NULL WHEN 0 THEN 'last' ELSE 'whole' END AS last,
  CASE k WHEN 4 THEN NULL WHEN 0 THEN 'text' ELSE 'whole' END AS rest,
  CASE k WHEN 4 THEN NULL WHEN 2 THEN 'whole' WHEN 3 THEN lang ELSE t END AS deep,
  CASE k WHEN 4 THEN NULL WHEN 1 THEN t ELSE 'whole' END AS member,
  CASE k WHEN 4 THEN NULL WHEN 2 THEN t ELSE 'whole' END AS odd, CASE k WHEN 4 THEN NULL WHEN 2 THEN t ELSE 'whole' END AS "inner"
FROM (SELECT doc_id, nullif(text, '') AS t, lang,
  CASE WHEN text IS NULL OR (lang IS NULL AND doc_id % 5 IN (1, 3)) THEN 4 ELSE doc_id % 5 END AS k FROM documents)""",
    "model_ledger": """SELECT doc_id, nullif(coalesce(text, 'None'), '') AS text, NULL::VARCHAR AS error,
  (SELECT count(DISTINCT coalesce(text, 'None')) FROM documents) AS asked, 0 AS asked_again FROM documents""",
    "routed_texts": _ROUTED,
    "model_answers": f"""SELECT page_id, {_prompt(_DEFAULT, 'text')} AS answer, NULL::VARCHAR AS error FROM ({_PAGE_TEXT})""",
    "model_failures": """SELECT page_id, CASE WHEN NOT contains(url, '7') THEN url END AS text, contains(url, '7') AS failed
FROM pages""",
    "extractive_summary": _SUMMARY,
    "extractive_summary_rare": _SUMMARY,
    "chat_requests": f"""SELECT conv_id, turn, len(ms) AS n_messages, {_MESSAGES} AS messages FROM ({_HISTORY})
WHERE role = 'user' AND turn > 0""",
    "chat_history": f"SELECT conv_id, turn, {_MESSAGES} AS messages FROM ({_HISTORY})",
    "chat_full": f"""SELECT conv_id, {_MESSAGES} AS text FROM (
  SELECT conv_id, list(json_object('role', role, 'content', text)::VARCHAR ORDER BY turn) AS ms FROM conversations GROUP BY conv_id)""",
    "line_rebuild": f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda l: array_to_string({_words('l')}, ' ')), chr(10)) AS text FROM documents""",
    "line_rebuild_gaps": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents",
    "page_lines": "SELECT doc_id, text || chr(10) AS text FROM documents",
    "sheet_text": _SHEETS,
    "sheet_text_all": f"""SELECT c_custkey AS doc_id, coalesce(text, '') AS text
FROM customer LEFT JOIN ({_SHEETS}) s ON s.doc_id = c_custkey""",
    "paragraph_text": """SELECT conv_id AS doc_id, string_agg(text || chr(10), ''
  ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS text FROM conversations GROUP BY conv_id""",
    "workbook_text": """SELECT o_orderkey::VARCHAR AS path, o_orderkey || ' '
  || CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderstatus || ' ' ELSE '' END || chr(10) || chr(10)
  || strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00 ' || o_orderpriority || ' ' || chr(10) AS text FROM orders""",
    "word_file_text": "SELECT doc_id::VARCHAR AS path, text || chr(10) AS text FROM documents",
    "glossary_valid": "SELECT p_partkey AS doc_id, p_partkey % 7 = 0 OR p_size % 5 IN (0, 1) AS valid FROM part",
    "glossary_terms": _GLOSSARY,
    "glossary_new": _CATALOG,
    "glossary_placed": _PLACED,
    "catalog_terms": _PLACED,
    "catalog_rerun": f"SELECT DISTINCT * FROM ({_PLACED}) WHERE name IS NOT NULL",
    "write_outcomes": r"""WITH p AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'no text to write' ELSE CASE doc_id % 11
    WHEN 0 THEN 'no path' WHEN 1 THEN 'path leaves its folder' WHEN 2 THEN 'path of a folder' WHEN 3 THEN 'name too long'
    ELSE 'not in iso-8859-1: ' || nullif(regexp_extract(text, '[^\x{00}-\x{ff}]'), '') END END AS error FROM documents)
  SELECT doc_id, error IS NULL AS status, error, count(*) OVER () AS rows, count(*) FILTER (error IS NULL) OVER () AS written,
    count(error) OVER () AS failed FROM p""",
    "local_files": _FILES,
    "object_files": _FILES,
    "stored_texts": f"""SELECT doc_id, text, text IS NOT NULL AS status,
  CASE WHEN text IS NULL THEN 'no text to write' END AS error FROM ({_RESPONSES})""",
}
