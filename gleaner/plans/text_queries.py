"""Queries of text functions, setup reports and small rollups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.operators import lint, rollups, secrets, setup, symbols
from gleaner.runtime import table
from gleaner.streaming import chats


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "notes_search").dropDuplicates(["entry_id"])


def f_labels(spark, sf_dir):
    """Labels of every search entry: category, tags, file category, result path."""
    e = _entries(spark, sf_dir)
    return e.select(
        "entry_id", t.title_case("category").alias("category"), t.category("path").alias("file_category"), t.result_path("path", "title", "scope_key").alias("result"),
        F.array_join(F.transform(t.valid_tags("keywords"), t.pill_label), "|").alias("pills"), t.file_stem("path").alias("stem"), t.statement_hash("title").alias("hash"),
    )


def f_highlight(spark, sf_dir):
    """Titles with their own third and fourth word marked."""
    e = _entries(spark, sf_dir).where("title is not null")
    return e.select("entry_id", t.highlighted("title", F.slice(F.split(F.lower("title"), "[^a-z0-9]+"), 3, 2)).alias("html"))


def f_browser_snippets(spark, sf_dir):
    """A snippet of every note around its title's last word."""
    n = table(spark, sf_dir, "notes").dropDuplicates(["note_id"])
    return n.select("note_id", t.browser_snippet("text", "title", F.lit("A preview. Of it."), F.slice(F.reverse(F.split(F.lower("title"), "[^a-z0-9]+")), 1, 1)).alias("snippet"))


def f_prose(spark, sf_dir):
    """The first prose line of every note, and what a frontmatter made of its title says."""
    n = table(spark, sf_dir, "notes").dropDuplicates(["note_id"])
    front = F.concat(F.lit("---\nname: \""), F.coalesce("title", F.lit("none")), F.lit("\"\nuser-invocable: "), F.when(F.col("note_id") % 2 == 0, "false").otherwise("true"), F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    m = t.frontmatter(front, "filename")
    return n.select("note_id", t.first_prose_line("text").alias("prose"), m["name"].alias("name"), m["user_invocable"].alias("invocable"))


def f_json(spark, sf_dir):
    """The statement in every packet file, wrapped as a chatty answer would wrap it."""
    p = table(spark, sf_dir, "packet_files").dropDuplicates(["packet_id"])
    said = F.concat(F.lit("<think>{no}</think>"), F.when(F.col("packet_id") % 2 == 0, "```json\n").otherwise("Here it is: "), "payload", F.when(F.col("packet_id") % 2 == 0, "\n```").otherwise(" so far"))
    return p.select("packet_id", F.try_variant_get(t.recovered_json(said), "$.statement", "string").alias("statement"))


def f_scalars(spark, sf_dir):
    """Rounding, labels and clamps over all order lines and parts."""
    l = table(spark, sf_dir, "lineitem")
    x = F.col("l_extendedprice") / 7
    return l.select("l_orderkey", "l_linenumber", t.round_to(x, 3).alias("rounded"), t.elapsed_label(x / 10).alias("took"), t.ago_label(x).alias("ago"), t.parsed_int(F.concat(F.lit(" "), F.floor(x).cast("string"), F.lit("px")), 10, 5000, 7).alias("clamped"), t.iso_time("l_shipdate").alias("iso"))


def f_languages(spark, sf_dir):
    p = table(spark, sf_dir, "packet_files").select("file_path").distinct()
    ext = F.element_at(F.array(*map(F.lit, (".PY", ".rs", ".sql", ".zzz", ".json"))), (F.pmod(F.length("file_path"), F.lit(5)) + 1).cast("int"))
    made = F.concat("file_path", ext)
    return p.select("file_path", t.guessed_language(made).alias("guessed"), t.extension_of(t.guessed_language(made)).alias("ending"))


def f_paths(spark, sf_dir):
    """The four notions of a test path, and staged files that are warned of, over made-up names."""
    e = _entries(spark, sf_dir)
    kinds = ("src/tests/{}_test.go", "test_{}.py", "web/{}.spec.ts", "java/{}Tests.java", "a/{}.log", "b/ID_RSA{}", "__tests__/{}.js", "src/{}.rs")
    path = F.element_at(F.array(*[F.concat(*[F.lit(x) for x in k.split("{}")[:1]], F.col("entry_id").cast("string"), F.lit(k.split("{}")[1])) for k in kinds]), (F.col("entry_id") % len(kinds) + 1).cast("int"))
    p = e.select("entry_id", path.alias("path"))
    return p.select("entry_id", "path", symbols.is_test_path(F.col("path")).alias("index_test"), lint.is_test_path(F.col("path")).alias("lint_test"), setup.is_test_path(F.col("path")).alias("setup_test"), F.col("path").rlike(lint.TEST_FILE).alias("java_test"), secrets.is_staged_sensitive(F.col("path")).alias("staged"))


#: (divisor, path, text) of the files that a customer's project has, by the customer's key; in SQL that both engines read.
FILES = (
    (3, "'Cargo.toml'", "''"), (3, "'src/main.rs'", "''"), (11, "'go.mod'", "''"), (13, "'requirements.txt'", "''"), (26, "'setup.py'", "''"), (17, "'pom.xml'", "''"), (9, "'Makefile'", "''"), (7, "'tests/a.py'", "''"),
    (2, "'.github/workflows/ci.yml'", "''"), (6, "'LICENSE'", "''"), (8, "'docs/x.md'", "''"), (10, "'.eslintrc.json'", "''"), (12, "'.gitignore'", "''"), (14, "'.editorconfig'", "''"), (1, "concat('lib/f', c_custkey, '.kt')", "''"),
    (4, "'package.json'", "concat('{\"description\": \"', case when c_custkey % 8 = 0 then concat('It is ', c_name) else '' end, '\", \"scripts\": {\"build\": \"b\"', case when c_custkey % 16 = 0 then ', \"lint\": \"l\"' else '' end, '}}')"),
    (5, "'README.md'", "concat('# Title', chr(10), chr(10), '![badge](x)', chr(10), '> Prose about ', c_name, chr(10))"),
)
_FILES = " union all ".join(f"select concat('c', c_custkey) as project, {path} as path, {text} as text from customer where c_custkey % {k} = 0" for k, path, text in FILES)


def _projects(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("gleaner_customer")
    return spark.sql(_FILES.replace("from customer", "from gleaner_customer"))


def s_setup(spark, sf_dir):
    r = setup.report(_projects(spark, sf_dir))
    return r.select("project", "files", "purpose", *[F.array_join(c, "; ").alias(c) for c in ("top_folders", "stacks", "languages", "entry_points", "gaps", "questions")])


def s_project_types(spark, sf_dir):
    rules = [("Cargo.toml", "Rust"), ("go.mod", "Go"), ("package.json", "JavaScript/TypeScript"), ("requirements.txt", "Python"), ("setup.py", "Python"), ("Makefile", "Make-based"), ("pom.xml", "Java (Maven)")]
    return setup.project_type(setup.signals(_projects(spark, sf_dir)), rules, "Unknown")


def s_sanitised(spark, sf_dir):
    """Every readable packet file as it would be handed in."""
    return rollups.sanitised(table(spark, sf_dir, "packet_files"), "packet_id", "payload")


def s_quota(spark, sf_dir):
    """What is left of a monthly quota of ten events."""
    return rollups.monthly_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 10)


def s_facet_index(spark, sf_dir):
    """How many principles every topic and applicability has, and the smallest of them."""
    return rollups.facet_index(table(spark, sf_dir, "principles"), "record_id", "topics", "applicability")


def s_change_summary(spark, sf_dir):
    """The notes of every origin as a change would be summed up."""
    return rollups.change_summary(table(spark, sf_dir, "notes").select("origin", "filename").distinct(), "origin", "filename")


def s_paired(spark, sf_dir):
    """Events paired as begin and end: a view begins, the user's next purchase ends it."""
    return rollups.paired(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


def s_session_facts(spark, sf_dir):
    """First request, last title and first time of every user's log."""
    e = table(spark, sf_dir, "events").dropDuplicates(["event_id"])
    return rollups.session_facts(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("line"), F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "title").alias("kind"), F.col("props").alias("value"), "ts"))


#: The edit that an event stands for, by its number; in SQL that both engines read.
_EDIT = """event_id as line, ts as tm, case when event_id % 6 in (0, 4) then 2 when event_id % 6 = 5 then 0 else 1 end as kind, case event_id % 6 when 2 then 'customTitle' when 5 then null else 'requests' end as k0,
  case event_id % 6 when 1 then cast(event_id % 11 as varchar(9)) when 3 then cast(event_id % 10 as varchar(9)) when 4 then cast(event_id % 10 as varchar(9)) end as k1, case event_id % 6 when 1 then 'modelState' when 3 then 'response' when 4 then 'response' end as k2,
  case event_id % 6 when 0 then concat('[{"message":{"text":"Ask ', event_id, '"}},{"message":{"text":"More"}}]') when 1 then concat('{"value":', event_id % 3, '}') when 2 then concat('"Title ', event_id, '"')
  when 3 then concat('{"invocationMessage":"Run ', event_id, '"}') when 4 then concat('[{"kind":"progressMessage","content":"Step ', event_id, '"}]') else '{broken' end as v, case when event_id % 6 = 0 then cast(event_id % 9 as int) end as off"""


def t_chat_states(spark, sf_dir):
    """What every user's events come to, read as the edits of a chat session, an hour before the last event."""
    table(spark, sf_dir, "events").createOrReplaceTempView("gleaner_events")
    e = spark.sql(f"select user_id as session, {_EDIT} from gleaner_events where user_id is not null")
    edits = e.select("session", "line", F.col("tm").alias("at"), "kind", F.array_compact(F.array("k0", "k1", "k2")).alias("k"), "v", F.col("off").alias("offset"))
    now = e.agg(F.max("tm")).first()[0]
    return chats.chat_states(edits, F.lit(now) - F.expr("interval 1 hour"), 12 * 3600)


_E = "e as (select distinct on (entry_id) * from notes_search)"
_WORDY = "array_to_string(list_transform(list_filter(string_split_regex({0}, '[-_]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"
_CAT = "case {0} when 'ai' then 'AI' when 'api' then 'API' when 'auth' then 'Auth' when 'ci' then 'CI' when 'cli' then 'CLI' when 'css' then 'CSS' when 'ddd' then 'DDD' when 'genai' then 'GenAI' when 'ide' then 'IDE' when 'iot' then 'IoT' when 'lsp' then 'LSP' when 'ml' then 'ML' when 'os' then 'OS' when 'sre' then 'SRE' when 'svg' then 'SVG' when 'web3' then 'Web3' else " + _WORDY + " end"
_ACR = "('cs','rdf','sha','api','cli','ui','ux','os','ai','ml','sql','http','css','js','ts','dfs','bfs','mst','dag','cfg','scc','neo4j','vpc','dns','tls','ssh','jwt','rbac','cicd','cdn','yaml','json','xml','html','wasm','grpc')"
_KINDS = "case entry_id % 8 when 0 then 'src/tests/' || entry_id || '_test.go' when 1 then 'test_' || entry_id || '.py' when 2 then 'web/' || entry_id || '.spec.ts' when 3 then 'java/' || entry_id || 'Tests.java' when 4 then 'a/' || entry_id || '.log' when 5 then 'b/ID_RSA' || entry_id when 6 then '__tests__/' || entry_id || '.js' else 'src/' || entry_id || '.rs' end"
SQL = {
    "f_labels": f"""with {_E}, k as (select *, regexp_extract(path, '[^/]*$') base from e), s as (select *, lower(coalesce(category, '')) lc, lower(coalesce(nullif(string_split(regexp_replace(base, '\\.md$', ''), '-')[1], ''), 'notes')) fc from k)
      select entry_id, {_CAT.format("lc")} as category, case when path is null then '' else {_CAT.format("fc")} end as file_category,
        coalesce(scope_key, 'Knowledge') || ' · ' || trim(regexp_replace(case when trim(coalesce(path, '')) = '' then coalesce(title, 'Note') when base = '' then trim(path) else base end, '\\s+[·—–]\\s+.*$', '')) as result,
        array_to_string(list_transform(list_filter(keywords, lambda t: t is not null and t <> '' and not contains(t, '/') and not regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') and length(t) <= 40),
          lambda t: case when lower(t) in {_ACR} then upper(t) else array_to_string(list_transform(regexp_extract_all(lower(t), '[a-z0-9_]+|[^a-z0-9_]+'), lambda w: upper(w[1]) || w[2:]), '') end), '|') as pills,
        regexp_replace(base, '(.)\\.[^.]*$', '\\1') as stem, sha256(trim(regexp_replace(title, '\\s+', ' ', 'g'))) as hash from s""",
    "f_highlight": f"""with {_E}, w as (select entry_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') h, list_filter(string_split_regex(lower(title), '[^a-z0-9]+')[3:4], lambda x: x <> '') t from e where title is not null)
      select entry_id, case when len(t) = 0 then h else regexp_replace(h, '(?i)\\b(' || array_to_string(t, '|') || ')\\b', '<mark>\\1</mark>', 'g') end as html from w""",
    "f_prose": r"""with n as (select distinct on (note_id) * from notes), l as (select note_id, unnest(string_split_regex(text, '\r?\n')) s, generate_subscripts(string_split_regex(text, '\r?\n'), 1) i from n where text is not null),
      k as (select note_id, i, trim(regexp_replace(trim(s), '^>+', '')) p from l where trim(s) <> '' and trim(s)[1] not in ('#', '!', '<')),
      f as (select note_id, arg_min(p, i) prose from k where strlen(p) >= 12 group by 1)
      select n.note_id, prose, regexp_replace(trim('"' || coalesce(title, 'none') || '"'), '^["'']|["'']$', '', 'g') as name, n.note_id % 2 <> 0 as invocable from n left join f using (note_id)""",
    "f_json": "select packet_id, any_value(case when json_valid(payload) then json_extract_string(payload, '$.statement') end) as statement from packet_files group by 1",
    "f_scalars": """with x as (select *, l_extendedprice / 7 x from lineitem), y as (select *, floor(x / 10 + 0.5)::bigint a, floor(x + 0.5)::bigint b from x)
      select l_orderkey, l_linenumber, floor(x * 1000 + 0.5) / 1000 as rounded, case when a < 60 then a || 's' when a % 60 > 0 then (a // 60) || ' min ' || (a % 60) || 's' else (a // 60) || ' min' end as took,
        case when b < 60 then 'just now' when b < 3600 then (b // 60) || ' min ago' else (b // 3600) || ' hr ago' end as ago, greatest(10, least(5000, floor(x)::bigint)) as clamped, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') as iso from y""",
    "f_languages": """with p as (select distinct file_path from packet_files), q as (select file_path, case length(file_path) % 5 when 0 then 'python' when 1 then 'rust' when 2 then 'sql' when 3 then 'text' else 'javascript' end g from p)
      select file_path, g as guessed, case g when 'python' then '.py' when 'rust' then '.rs' when 'sql' then '.sql' when 'javascript' then '.js' else '.txt' end as ending from q""",
    "f_paths": f"""with {_E}, p as (select entry_id, {_KINDS} as path from e)
      select entry_id, path, entry_id % 8 in (0, 1, 2, 3) as index_test, entry_id % 8 in (0, 2) as lint_test, entry_id % 8 in (0, 1, 2, 6) as setup_test, entry_id % 8 in (0, 3) as java_test, entry_id % 8 in (4, 5) as staged from p""",
    "s_setup": f"""with f as ({_FILES}), m as (select project, count(*) n, list(path) ps, max(text) filter (where path = 'package.json') pk, max(text) filter (where path = 'README.md') rd from f group by 1),
      s as (select *, list_contains(ps, 'package.json') nj, list_contains(ps, 'Cargo.toml') ru, list_contains(ps, 'go.mod') gg, list_contains(ps, 'requirements.txt') py, list_contains(ps, 'pom.xml') mv, list_contains(ps, 'Makefile') mk, list_contains(ps, 'tests/a.py') te from m),
      p as (select *, coalesce(nullif(json_extract_string(pk, '$.description'), ''), regexp_extract(rd, '> ([^\\n]*)', 1)) pu from s)
      select project, n as files, nullif(pu, '') as purpose, array_to_string(list_sort(list_distinct(list_transform(list_filter(ps, lambda x: contains(x, '/')), lambda x: string_split(x, '/')[1]))), '; ') as top_folders,
        nullif(array_to_string(list_filter([case when nj then 'Node.js | package.json | npm run build' || case when contains(pk, 'lint') then ' | npm run lint' else '' end end, case when ru then 'Rust | Cargo.toml | cargo build --release | cargo test | cargo clippy && cargo fmt --check' end,
          case when gg then 'Go | go.mod | go build ./... | go test ./... | go vet ./...' end, case when py then 'Python | ' || case when list_contains(ps, 'setup.py') then 'setup.py' else 'requirements.txt' end || ' | pytest | ruff check . || flake8' end,
          case when mv then 'Java (Maven) | pom.xml | mvn -q compile | mvn -q test' end, case when mk and not (nj or ru or gg or py or mv) then 'Make | Makefile | make | make test' end], lambda x: x is not null), '; '), '') as stacks,
        (select string_agg(l || ' ' || c, '; ' order by c desc, l) from (select l, count(*) c from (select case when x like '%.rs' then 'Rust' when x like '%.py' then 'Python' when x like '%.md' then 'Markdown' when x like '%.kt' then 'Kotlin' end l from unnest(ps) u(x)) where l is not null group by 1)) as languages,
        case when ru then 'src/main.rs' else '' end as entry_points,
        array_to_string(list_filter([case when not list_contains(ps, 'README.md') then 'Add a README.md stating the project''s purpose, setup, and usage.' end, case when not te then 'Add a test suite — no test files detected.' end,
          case when not list_contains(ps, '.github/workflows/ci.yml') then 'Add CI (e.g. .github/workflows) to build, test, and lint on push.' end, case when not list_contains(ps, '.eslintrc.json') and (nj or ru or gg or py or mv or mk) then 'Add linter/formatter config so style is enforced consistently.' end,
          case when not list_contains(ps, 'LICENSE') then 'Add a LICENSE so the terms of use are explicit.' end, case when not list_contains(ps, '.gitignore') then 'Add a .gitignore so build artifacts never pollute the repo.' end,
          case when not list_contains(ps, '.editorconfig') then 'Consider an .editorconfig for consistent whitespace across editors.' end, case when not list_contains(ps, 'docs/x.md') then 'Consider a docs/ directory once the public surface stabilizes.' end], lambda x: x is not null), '; ') as gaps,
        array_to_string(list_filter([case when nullif(pu, '') is null then 'What is the primary goal of this project, in one sentence?' end, case when nullif(pu, '') is null then 'Who is the intended user, and what is the single most important thing it must do well?' end,
          'What does "done" look like — the concrete acceptance criteria for this project?', case when not te then 'What is the testing strategy and the expected level of coverage?' end, 'Are there constraints (deadline, platforms, dependencies, performance) I must respect?'], lambda x: x is not null), '; ') as questions from p""",
    "s_project_types": f"""with f as ({_FILES}) select project, case when bool_or(path = 'Cargo.toml') then 'Rust' when bool_or(path = 'go.mod') then 'Go' when bool_or(path = 'package.json') then 'JavaScript/TypeScript'
      when bool_or(path in ('requirements.txt', 'setup.py')) then 'Python' when bool_or(path = 'Makefile') then 'Make-based' when bool_or(path = 'pom.xml') then 'Java (Maven)' else 'Unknown' end as type from f group by 1""",
    "s_sanitised": r"""with f as (select packet_id, any_value(payload) j from packet_files where json_valid(payload) group by 1), g as (select packet_id, j, trim(regexp_replace(json_extract_string(j, '$.statement'), '[\s\pZ]+', ' ', 'g')) s from f)
      select packet_id as id, json_extract_string(j, '$.kind') as kind, json_extract_string(j, '$.topic') as topic, s as statement, coalesce(json_extract_string(j, '$.publicSummary'), '') as public_summary, coalesce(json_extract_string(j, '$.cautionNotes'), '') as caution_notes, sha256(s) as statement_hash from g where s is not null""",
    "s_quota": "with e as (select distinct on (event_id) * from events where user_id is not null and ts is not null) select user_id as key, strftime(ts, '%Y-%m') as month, count(*) as n, greatest(0, 10 - count(*)) as remaining from e group by 1, 2",
    "s_facet_index": """with r as (select distinct on (record_id) * from principles), f as (select 'topic' facet, unnest(topics) as label, record_id from r union all select 'applicability', applicability, record_id from r)
      select facet, label, count(distinct record_id) as n, min(record_id) as first_id from f where label is not null group by 1, 2""",
    "s_change_summary": """with f as (select distinct origin, filename from notes where filename is not null), r as (select *, row_number() over (partition by origin order by filename) k, count(*) over (partition by origin) n from f)
      select origin as grp, any_value(n) as n, string_agg(filename, ', ' order by filename) filter (where k <= 3) || case when any_value(n) > 3 then ' +' || (any_value(n) - 3) || ' more' else '' end as summary from r group by 1""",
    "s_paired": """with e as (select distinct on (event_id) * from events where user_id is not null and ts is not null and event_type in ('view', 'purchase')),
      x as (select *, lead(event_type) over w nx, lead(ts) over w nt from e window w as (partition by user_id order by ts, event_id))
      select user_id as key, event_id as begin_id, ts as began, case when nx = 'purchase' then nt end as ended, case when nx = 'purchase' then floor((epoch_us(nt) - epoch_us(ts)) / 1000000)::bigint end as seconds from x where event_type = 'view'""",
    "s_session_facts": """with e as (select distinct on (event_id) * from events where user_id is not null)
      select user_id as session, arg_min(props, event_id) filter (where event_type = 'view') as first_request, arg_max(props, event_id) filter (where event_type = 'click') as title, min(ts) as created, count(*) as lines from e group by 1""",
}
SQL["t_chat_states"] = f"""with e as (select distinct on (user_id, line) * from (select user_id, {_EDIT} from events where user_id is not null)),
 g as (select user_id, max(greatest(case when k0 = 'requests' then k1::int end, case when kind = 2 and k1 is null and k0 = 'requests' then off + 1 end)) last, max(case when k2 = 'modelState' and json_extract(v, '$.value')::int <> 2 then k1::int end) done,
  arg_max(json_extract_string(v, '$'), line) filter (where k0 = 'customTitle') title, arg_min(json_extract_string(v, '$[0].message.text'), line) filter (where line % 6 = 0) prompt, arg_max(json_extract_string(v, '$.invocationMessage'), line) filter (where line % 6 = 3) calls,
  arg_max(json_extract_string(v, '$[0].content'), line) filter (where line % 6 = 4) progress, min(tm) started, max(tm) changed, count(*) edits from (select * exclude v, case when json_valid(v) then v end v from e) group by 1)
select user_id::varchar as session, coalesce(last, -1) as last_request, coalesce(last, -1) >= 0 and coalesce(done, -1) < coalesce(last, -1) and changed >= (select max(ts) from events) - interval 13 hour as active, coalesce(title, prompt, 'Chat') as title, coalesce(calls, progress) as preview, started, changed, edits from g"""
QUERIES = {
    f.__name__: f
    for f in (t_chat_states, f_labels, f_highlight, f_browser_snippets, f_prose, f_json, f_scalars, f_languages, f_paths, s_setup, s_project_types, s_sanitised, s_quota, s_facet_index, s_change_summary, s_paired, s_session_facts)
}
