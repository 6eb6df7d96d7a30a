"""DuckDB counterparts of the catalogue's queries.

The SQL is put together from common table expressions: ``c`` (clean chunks), ``q`` (clean
questions), the index (``t post sz w hv``) and, per batch of queries, ``<p>_ranked`` and
``<p>_hits``.
"""

from __future__ import annotations

from corvane.functions.text import STOP_WORDS


def _tok(x: str) -> str:
    return (
        rf"list_transform(list_filter(regexp_split_to_array(regexp_replace({x},'([a-z0-9])([A-Z])','\1 \2','g'),'[^\p{{L}}\p{{N}}]+'), "
        "lambda x: x<>''), lambda x: lower(replace(x,'İ','i̇')))"
    )


def _lines(x: str) -> str:
    parts = rf"regexp_split_to_array({x},'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"(CASE WHEN {parts}[-1]='' THEN list_slice({parts},1,len({parts})-1) ELSE {parts} END)"


def _path(x: str) -> str:
    return rf"regexp_replace(replace(trim({x}),'\','/'),'^(\./+)+','')"


def _dir(x: str) -> str:
    return f"regexp_replace({x},'/?[^/]*$','')"


C = "c AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY indexed_at DESC NULLS LAST, content_hash) rn FROM chunks) WHERE rn=1)"
Q = f"""q AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY question, split, array_to_string(expect_files,','),
 array_to_string(expect_symbols,','), set_name NULLS FIRST) rn FROM (SELECT id, question,
 list_sort(list_distinct(list_transform(list_filter(expect_files, lambda f: f IS NOT NULL AND trim(f)<>''), lambda f: {_path("f")}))) expect_files,
 list_sort(list_distinct(list_filter(coalesce(expect_symbols,[]), lambda x: x IS NOT NULL AND x<>''))) expect_symbols,
 CASE WHEN split IS NULL OR lower(trim(split))='' THEN 'dev' ELSE lower(trim(split)) END split, set_name, project_id
 FROM questions WHERE id IS NOT NULL AND question IS NOT NULL)) WHERE rn=1 AND len(expect_files)>0)"""
T = f"t AS (SELECT project_id scope, ord, {_tok("concat_ws(' ',coalesce(name,''),coalesce(context,''),coalesce(text,''))")} tokens FROM c)"
INDEX = [
    T,
    "post AS MATERIALIZED (SELECT scope, ord, term, count(*) tf FROM (SELECT scope, ord, unnest(tokens) term FROM t) GROUP BY ALL)",
    "sz AS (SELECT scope, count(*) n, avg(len(tokens)) avgdl FROM t GROUP BY scope)",
    "raw AS (SELECT scope, term, ln(n-df+0.5)-ln(df+0.5) raw FROM (SELECT scope, term, count(*) df FROM post GROUP BY ALL) JOIN sz USING (scope))",
    "w AS MATERIALIZED (SELECT scope, term, CASE WHEN raw<0 THEN 0.25*(avg(raw) OVER (PARTITION BY scope)) ELSE raw END idf FROM raw)",
    "dl AS (SELECT scope, ord, len(tokens) dl FROM t)",
]
_BUCKET = "(('0x'||substr(md5(term),1,8))::BIGINT % 512)"
HASHED = [
    f"ht AS (SELECT scope, ord, {_BUCKET} bucket, count(*) tf FROM (SELECT project_id scope, ord, unnest({_tok("concat_ws(chr(10)||chr(10),coalesce(context,''),coalesce(text,''))")}) term FROM c) GROUP BY ALL)",
    "hv AS MATERIALIZED (SELECT scope, ord, bucket, tf/sqrt(sum(tf*tf) OVER (PARTITION BY scope, ord)) w FROM ht)",
    "cw AS (SELECT ord, CASE WHEN kind='class' AND NOT contains(coalesce(text,''),'def ') THEN 0.4 ELSE 1.0 END weight FROM c)",
]


def _bm25(p: str, k: int) -> list[str]:
    """Ranking of the queries in ``<p>_q (query_id scope text)``."""
    return [
        f"{p}_qt AS MATERIALIZED (SELECT query_id, scope, term, count(*) qtf FROM (SELECT query_id, scope, unnest({_tok('text')}) term FROM {p}_q) GROUP BY ALL)",
        f"""{p}_bs AS (SELECT query_id, ord, round(sum(qtf*idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))),9) score FROM {p}_qt JOIN w USING (scope, term)
 JOIN post USING (scope, term) JOIN dl USING (scope, ord) JOIN sz USING (scope) GROUP BY ALL)""",
        f"{p}_bm AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) rank FROM {p}_bs WHERE score>0) WHERE rank<={k})",
    ]


def _hash(p: str, k: int) -> list[str]:
    return [
        f"{p}_hq AS (SELECT query_id, scope, bucket, tf/sqrt(sum(tf*tf) OVER (PARTITION BY query_id, scope)) qw FROM (SELECT query_id, scope, {_BUCKET} bucket, sum(qtf)::DOUBLE tf FROM {p}_qt GROUP BY ALL))",
        f"{p}_hs AS (SELECT query_id, ord, round(sum(w*qw),9) score FROM hv JOIN {p}_hq USING (scope, bucket) GROUP BY ALL)",
        f"{p}_hm AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) rank FROM {p}_hs WHERE score>0) WHERE rank<={k})",
    ]


def _candidates(p: str, pool: int, mode: str = "hybrid", dense: bool = False, bm25_weight: float = 1.0) -> list[str]:
    bm = _bm25(p, pool)
    parts = {"bm25": f"SELECT query_id, ord, 0 pos, 'bm25' m, rank FROM {p}_bm", "vector": f"SELECT query_id, ord, 1 pos, 'vector' m, rank FROM {p}_hm"}
    union = " UNION ALL ".join(parts.values()) if mode == "hybrid" else parts[mode]
    return [
        *bm,
        *(_dense(p, pool) if dense else _hash(p, pool) if mode != "bm25" else []),
        f"{p}_u AS (SELECT query_id, ord, sum(CASE WHEN m='bm25' THEN {bm25_weight} ELSE 1.0 END/(60+rank)) score, min((pos, rank)) first, string_agg(m, ',' ORDER BY pos) sources FROM ({union}) GROUP BY ALL)",
        f"{p}_fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, first) frank FROM {p}_u) WHERE frank<={pool})",
        f"""{p}_ranked AS MATERIALIZED (SELECT query_id, ord, score*weight score, sources, row_number() OVER (PARTITION BY query_id ORDER BY round(score*weight,12) DESC, frank) rank
 FROM {p}_fused JOIN cw USING (ord))""",
    ]


EDGES = [
    "im AS (SELECT * FROM c WHERE kind='module')",
    r"""ie AS (SELECT project_id scope, path importer, unnest(list_zip(regexp_extract_all(text,'(?m)^from (\.+)([\p{L}\p{N}_.]*) import',1),
 regexp_extract_all(text,'(?m)^from (\.+)([\p{L}\p{N}_.]*) import',2))) i FROM im)""",
    "ip AS (SELECT scope, importer, string_split(importer,'/')[1:-2] pkg, len(i[1])-1 up, i[2] name FROM ie)",
    "ib AS (SELECT scope, importer, list_concat(list_slice(pkg,1,greatest(len(pkg)-up,0)), CASE WHEN name='' THEN [] ELSE string_split(name,'.') END) parts FROM ip)",
    "it AS (SELECT DISTINCT scope, importer, array_to_string(parts,'/')||'.py' target FROM ib WHERE len(parts)>0)",
    "edges AS MATERIALIZED (SELECT DISTINCT it.* FROM it JOIN im ON im.project_id=it.scope AND im.path=it.target WHERE target<>importer)",
    "mods AS (SELECT project_id scope, path, max(ord) ord FROM im GROUP BY ALL)",
]


def _hits(p: str, k: int) -> list[str]:
    """``<p>_hits``: head and the expansion stages with their positions."""
    return [
        f"{p}_r AS MATERIALIZED (SELECT r.query_id, r.ord, r.score, r.rank, c.project_id scope, c.path, {_dir('c.path')} dir FROM {p}_ranked r JOIN c USING (ord))",
        f"{p}_s0 AS (SELECT query_id, scope, ord, path, score, 0 stage, rank AS nth_at FROM {p}_r WHERE rank<={k})",
        f"""{p}_s1 AS (SELECT query_id, scope, ord, path, score, 1 stage, slot AS nth_at FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) slot
 FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, scope, path) m FROM {p}_r) WHERE rank=m AND m>{k} AND m<=60) WHERE slot<=4)""",
        f"{p}_a AS MATERIALIZED (SELECT * FROM {p}_s0 UNION ALL SELECT * FROM {p}_s1)",
        f"{p}_strong AS (SELECT query_id, scope, {_dir('path')} dir FROM {p}_a GROUP BY ALL HAVING count(DISTINCT path)>=2)",
        f"""{p}_s2 AS (SELECT query_id, scope, ord, path, score, 2 stage, slot AS nth_at FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) slot FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id, scope, path ORDER BY rank) nth FROM {p}_r r WHERE rank<=60
 AND NOT EXISTS (SELECT 1 FROM {p}_a a WHERE a.query_id=r.query_id AND a.scope=r.scope AND a.path=r.path)
 AND EXISTS (SELECT 1 FROM {p}_strong s WHERE s.query_id=r.query_id AND s.scope=r.scope AND s.dir=r.dir)) WHERE nth=1) WHERE slot<=2)""",
        f"{p}_b AS MATERIALIZED (SELECT * FROM {p}_a UNION ALL SELECT * FROM {p}_s2)",
        f"{p}_ch AS (SELECT query_id, scope, path, min((stage, nth_at)) place FROM {p}_b GROUP BY ALL)",
        f"""{p}_rf AS (SELECT ch.query_id, ch.scope, e.importer path, min(place) place FROM {p}_ch ch JOIN edges e ON e.scope=ch.scope AND e.target=ch.path
 JOIN (SELECT scope, target, count(*) users FROM edges GROUP BY ALL) u ON u.scope=ch.scope AND u.target=ch.path WHERE users BETWEEN 1 AND 5
 AND NOT EXISTS (SELECT 1 FROM {p}_ch o WHERE o.query_id=ch.query_id AND o.scope=ch.scope AND o.path=e.importer) GROUP BY ALL)""",
        f"""{p}_s3 AS (SELECT query_id, scope, ord, path, 0.0 score, 3 stage, slot AS nth_at FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, path) slot FROM {p}_rf)
 JOIN mods USING (scope, path) WHERE slot<=2)""",
        f"""{p}_hits AS MATERIALIZED (SELECT query_id, ord, path, score, stage, row_number() OVER (PARTITION BY query_id ORDER BY stage, nth_at) pos
 FROM (SELECT * FROM {p}_b UNION ALL SELECT * FROM {p}_s3))""",
    ]


def _facets(p: str) -> list[str]:
    """``<p>_facets`` of the pool ``<p>_ranked``."""
    return [
        f"{p}_fr AS MATERIALIZED (SELECT query_id, ord, rank, name, {_dir("split_part(location,':',1)")} dir FROM {p}_ranked JOIN c USING (ord))",
        f"{p}_tot AS (SELECT query_id, count(*) total FROM {p}_fr GROUP BY ALL)",
        f"{p}_up AS MATERIALIZED (SELECT query_id, ord, rank, array_to_string(list_slice(string_split(dir,'/'),1,i),'/') node FROM (SELECT *, unnest(range(1,len(string_split(dir,'/'))+1)) i FROM {p}_fr WHERE dir<>''))",
        f"{p}_un AS (SELECT query_id, node, count(*) under, min(rank) best_rank, {_dir('node')} parent FROM {p}_up GROUP BY ALL)",
        f"""{p}_sel AS MATERIALIZED (SELECT a.query_id, a.node, a.best_rank FROM {p}_un a JOIN {p}_tot USING (query_id) LEFT JOIN {p}_un b ON b.query_id=a.query_id AND b.node=a.parent
 WHERE b.under IS NULL OR b.under>floor(total*0.25))""",
        f"{p}_own AS (SELECT f.query_id, f.ord, f.rank, f.name, f.dir, arg_max(node, length(node)) node FROM {p}_fr f JOIN {p}_up u USING (query_id, ord) JOIN {p}_sel s USING (query_id, node) GROUP BY ALL)",
        f"""{p}_fg AS (SELECT query_id, node, count(*) chunks, coalesce(list_sort(list(DISTINCT CASE WHEN dir<>node THEN split_part(substr(dir,length(node)+2),'/',1) END) FILTER (WHERE dir<>node)),[]) children
 FROM {p}_own GROUP BY ALL HAVING count(*)>=3)""",
        f"{p}_fs AS (SELECT query_id, node, list(name ORDER BY r) symbols FROM (SELECT query_id, node, name, min(rank) r FROM {p}_own GROUP BY ALL) GROUP BY ALL)",
        f"""{p}_facets AS MATERIALIZED (SELECT * FROM (SELECT query_id, node directory, chunks, best_rank, symbols, children, row_number() OVER (PARTITION BY query_id ORDER BY chunks DESC, best_rank, node) facet_rank
 FROM {p}_fg JOIN {p}_fs USING (query_id, node) JOIN {p}_sel USING (query_id, node)) WHERE facet_rank<=5)""",
        f"""{p}_fq AS (SELECT query_id, facet_rank, list_concat([text, string_split(directory,'/')[-1]], list_slice(CASE WHEN len(children)>0 THEN children ELSE symbols END,1,3)) words
 FROM {p}_facets JOIN {p}_q USING (query_id))""",
        f"{p}_fw AS (SELECT query_id, facet_rank, i, words[i] w FROM (SELECT *, unnest(range(1,len(words)+1)) i FROM {p}_fq))",
        f"""{p}_refined AS MATERIALIZED (SELECT query_id, facet_rank, string_agg(w,' ' ORDER BY i) text FROM (SELECT *, min(i) OVER (PARTITION BY query_id, facet_rank, lower(w)) first FROM {p}_fw)
 WHERE i=first GROUP BY ALL)""",
    ]


_STOP = ",".join(f"'{w}'" for w in STOP_WORDS)
NARROW = rf"array_to_string(list_slice(list_filter(regexp_extract_all(lower(replace(replace(question,'İ','i'),'I','ı')),'[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}) AND length(w)>2),1,1),' ')"
QUESTIONS = "a_q AS (SELECT id query_id, project_id scope, question AS text FROM q)"
NARROWED = f"a_q AS (SELECT id query_id, project_id scope, {NARROW} AS text FROM q)"
PER_QUESTION = [
    "j AS (SELECT id question_id, unnest(expect_files) path FROM q)",
    "hf AS (SELECT query_id question_id, path, min(pos) pos FROM a_hits GROUP BY ALL)",
    "mt AS (SELECT question_id, count(*) expected, count(pos) returned, min(pos) rank FROM j LEFT JOIN hf USING (question_id, path) GROUP BY ALL)",
    "nm AS (SELECT DISTINCT query_id question_id, name FROM a_hits JOIN c USING (ord))",
    """sy AS (SELECT question_id, bool_and(there) symbols_found FROM (SELECT q.id question_id, s.symbol, EXISTS (SELECT 1 FROM nm WHERE nm.question_id=q.id
 AND (nm.name=s.symbol OR ends_with(nm.name,'.'||s.symbol))) there FROM q, unnest(q.expect_symbols) s(symbol)) GROUP BY ALL)""",
    """pq AS (SELECT q.id question_id, split, set_name, expected, returned, rank, symbols_found, returned>0 found, returned/expected coverage
 FROM q JOIN mt ON mt.question_id=q.id LEFT JOIN sy ON sy.question_id=q.id)""",
]


def _wilson(s: str, n: str) -> tuple[str, str]:
    z = "1.96"
    centre = f"(({s}/{n}+{z}*{z}/(2*{n}))/(1+{z}*{z}/{n}))"
    half = f"({z}*sqrt(({s}/{n})*(1-{s}/{n})/{n}+{z}*{z}/(4*{n}*{n}))/(1+{z}*{z}/{n}))"
    return tuple(f"CASE WHEN {n}>0 THEN greatest(0,least(1,{centre}{sign}{half})) ELSE 0 END" for sign in "-+")


def _report(by: str) -> str:
    low, high = _wilson("hits", "n")
    group = f"GROUP BY {by}" if by else ""
    first = f"{by}, " if by else ""
    return f"""SELECT {first}n, round(hits/n,4) recall, round({low},4) recall_low, round({high},4) recall_high, round(cov,4) coverage,
 round(CASE WHEN n>=2 THEN greatest(0,least(1,cov-1.96*sqrt(v/n))) ELSE 0 END,4) coverage_low,
 round(CASE WHEN n>=2 THEN greatest(0,least(1,cov+1.96*sqrt(v/n))) ELSE 0 END,4) coverage_high,
 round(mrr,4) mrr, round(sr,4) symbol_recall FROM (SELECT {first}count(*) n, sum(found::INT)::BIGINT hits, avg(coverage) cov, coalesce(var_samp(coverage),0) v,
 avg(coalesce(1/rank,0)) mrr, avg(symbols_found::INT) sr FROM pq {group})"""


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


SEARCH = [C, Q, *INDEX, *HASHED, QUESTIONS, *_candidates("a", 60)]
FULL = [*SEARCH, *EDGES, *_hits("a", 8)]
TEST = r"(^|/)(tests?|testing)(/|$)|(^|/)test_[^/]*$|_test\.[a-z]+$"
CITE = r"`?([\p{L}\p{N}_./\\-]+\.[A-Za-z]{1,6}):(\d+)`?"
CITED = [
    f"""dx AS (SELECT doc_id, source, list_transform(list_zip(regexp_extract_all(text,'{CITE}',1), regexp_extract_all(text,'{CITE}',2)), lambda z: replace(z[1],'\\','/')||':'||z[2]) refs
 FROM (SELECT DISTINCT doc_id, source, text FROM documents WHERE text IS NOT NULL))""",
    "dy AS (SELECT doc_id, source, i, refs[i] citation FROM (SELECT *, unnest(range(1,len(refs)+1)) i FROM dx))",
    "cited AS MATERIALIZED (SELECT doc_id answer_id, source scope, citation, (row_number() OVER (PARTITION BY doc_id, source ORDER BY min(i)))-1 n FROM dy GROUP BY doc_id, source, citation)",
]
FILES = "files AS (SELECT project_id scope, path, max(greatest(coalesce(end_line,start_line),start_line)) n_lines FROM c WHERE path IS NOT NULL GROUP BY ALL)"
#: the chunks in fewer directories, each module importing the next and the first of its directory
LINKED = [
    C.replace("c AS", "c0 AS", 1),
    r"""c1 AS (SELECT * EXCLUDE path, CASE WHEN regexp_matches(path,'^[^/]+/.*[^/]$') THEN regexp_extract(path,'^[^/]+')||'/'||regexp_extract(path,'[^/]+$') ELSE path END path FROM c0)""",
    rf"""c2 AS (SELECT *, lead(regexp_extract(path,'([^/]+)\.py$',1)) OVER z following, first_value(regexp_extract(path,'([^/]+)\.py$',1)) OVER z hub FROM c1
 WINDOW z AS (PARTITION BY project_id, {_dir("path")}, kind ORDER BY path, ord))""",
    r"""c AS MATERIALIZED (SELECT * EXCLUDE (text, following, hub), CASE WHEN kind='module' THEN coalesce(text,'')||CASE WHEN following<>'' THEN chr(10)||'from .'||following||' import x' ELSE '' END
 ||CASE WHEN hub<>'' THEN chr(10)||'from .'||hub||' import x' ELSE '' END ELSE text END AS text FROM c2)""",
]
#: usable stored vectors of a provider, the chunks that have one, and every hundredth of them as a query
DENSE = [
    C.replace("c AS", "c0 AS", 1),
    "v0 AS (SELECT content_hash, vec::DOUBLE[] v FROM vectors WHERE provider='lokal' AND content_hash IS NOT NULL AND vec IS NOT NULL)",
    "vd AS (SELECT len(v) d FROM v0 WHERE len(v)>0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)",
    "vu AS MATERIALIZED (SELECT content_hash, min(v) v FROM v0 WHERE len(v)=(SELECT d FROM vd) AND len(list_filter(v, lambda x: NOT isfinite(x)))=0 AND list_max(list_transform(v, lambda x: abs(x)))>0 GROUP BY 1)",
    "c AS MATERIALIZED (SELECT * FROM c0 WHERE content_hash IN (SELECT content_hash FROM vu))",
    "a_q AS (SELECT ord::VARCHAR query_id, project_id scope, coalesce(name,'') AS text, v FROM c JOIN vu USING (content_hash) WHERE ord%100=0)",
    "a_hs AS (SELECT query_id, c.ord, round(list_cosine_similarity(a_q.v, vu.v),9) score FROM a_q JOIN c ON c.project_id=a_q.scope JOIN vu USING (content_hash))",
]


def _dense(p: str, k: int) -> list[str]:
    return [f"{p}_hm AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) rank FROM {p}_hs WHERE score>0) WHERE rank<={k})"]


#: lines of the documents with their fences and headings
MARKDOWN = [
    f"""ml AS (SELECT doc_id, i, rs[i] line FROM (SELECT doc_id, rs, unnest(range(1,len(rs)+1)) i FROM (SELECT DISTINCT doc_id, text, {_lines("text")} rs FROM documents WHERE text IS NOT NULL)))""",
    r"mf AS (SELECT *, sum((regexp_matches(line,'^\s*(```|~~~)'))::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 fenced FROM ml)",
    r"""mh AS MATERIALIZED (SELECT doc_id, i, length(regexp_extract(line,'^(#{1,6})\s+(.*)$',1)) lv, trim(regexp_extract(line,'^(#{1,6})\s+(.*)$',2)) title FROM mf
 WHERE fenced=0 AND regexp_full_match(line,'(#{1,6})\s+(.*)'))""",
    "mp AS (SELECT *, " + ", ".join(f"coalesce(max(CASE WHEN lv={n} THEN i END) OVER z,0) p{n}" for n in range(1, 7)) + " FROM mh WINDOW z AS (PARTITION BY doc_id ORDER BY i))",
    "mt1 AS (SELECT doc_id, i, lv, title, list_filter(["
    + ", ".join(f"CASE WHEN {n}<lv AND p{n}>greatest(0{''.join(f',p{m}' for m in range(1, n))}) THEN p{n} END" for n in range(1, 6))
    + "], lambda x: x IS NOT NULL) above FROM mp)",
    """mu AS (SELECT m.doc_id, m.i, m.title, string_agg(h.title,' > ' ORDER BY h.i) FILTER (h.title<>'') parent FROM (SELECT doc_id, i, title, unnest(CASE WHEN len(above)=0 THEN [0] ELSE above END) a FROM mt1) m
 LEFT JOIN mh h ON h.doc_id=m.doc_id AND h.i=m.a GROUP BY ALL)""",
]
#: functions' lines, where the definition begins, its last line of code, and whether a body on the line of its def goes on below
FUNCTIONS = [
    C,
    f"f0 AS (SELECT ord, text, {_lines('text')} rs FROM c WHERE kind='function' AND text IS NOT NULL)",
    r"""f1 AS (SELECT *, list_position(list_transform(rs, lambda x: regexp_matches(x,'^(@|def |async def )')),true) s,
 len(rs)+1-list_position(list_reverse(list_transform(rs, lambda x: NOT regexp_matches(x,'^\s*(#|$)'))),true) e FROM f0)""",
    r"fn AS (SELECT *, regexp_matches(rs[s],'^(async )?def [^#]*\)[^:]*:\s*[^\s#]') AND len(rs)>s AND regexp_matches(rs[s+1],'^\s') bad FROM f1)",
]
PROVIDERS = "pv AS (SELECT DISTINCT provider FROM vectors WHERE provider IS NOT NULL)"
HITS = "SELECT query_id, pos::INT pos, ord, path, round(score,6) score, stage FROM a_hits"


def _forward(p: str, chosen: str, out: str) -> list[str]:
    """Files that the files of ``chosen`` import, closest first, as ``out``."""
    return [
        f"""{out}_f AS (SELECT DISTINCT b.query_id, b.scope, e.target path FROM {chosen} b JOIN edges e ON e.scope=b.scope AND e.importer=b.path
 WHERE (b.scope, e.target) NOT IN (SELECT (scope, target) FROM hub) AND (b.scope, e.target) NOT IN (SELECT (scope, path) FROM shim)
 AND NOT EXISTS (SELECT 1 FROM {chosen} o WHERE o.query_id=b.query_id AND o.scope=b.scope AND o.path=e.target))""",
        f"""{out} AS (SELECT query_id, scope, ord, path, 0.0 score, 4 stage, slot AS nth_at FROM (SELECT f.query_id, f.scope, m.ord, f.path,
 row_number() OVER (PARTITION BY f.query_id ORDER BY cosine DESC NULLS LAST, f.path) slot FROM {out}_f f JOIN mods m USING (scope, path)
 LEFT JOIN allh h ON h.query_id=f.query_id AND h.ord=m.ord) WHERE slot<=2)""",
    ]


IMPORTED = [
    "allh AS (SELECT query_id, ord, score cosine FROM a_hs WHERE score>0)",
    "hub AS (SELECT scope, target FROM edges GROUP BY ALL HAVING count(*)>25)",
    f"""shim AS (SELECT DISTINCT project_id scope, path FROM c WHERE kind='module' AND NOT contains(text,'def ') AND NOT contains(text,'class ')
 AND len(list_filter({_lines("text")}, lambda x: NOT regexp_matches(x,'^\\s*(import |from |__all__\\s*=|#|\"\"\"|$)') AND NOT regexp_matches(trim(x),'^[\\p{{L}}\\p{{N}}_]+(\\s*:[^=]+)?\\s*=\\s*[A-Za-z_][\\p{{L}}\\p{{N}}_.]*\\s*$')))=0)""",
    *_forward("a", "a_b", "a_s4"),
    "a_b3 AS (SELECT * FROM a_b UNION ALL SELECT * FROM a_s3)",
    *_forward("a", "a_b3", "a_s5"),
]


def oracle_sql() -> dict[str, str]:
    linked = [*LINKED, Q, *INDEX, *HASHED, QUESTIONS, *_candidates("a", 60), *EDGES, *_hits("a", 8)]
    sample = [
        "sm0 AS (SELECT project_id, ord, name, location, count(*) OVER (PARTITION BY project_id, name) same FROM c JOIN cw USING (ord) WHERE kind IN ('function','method','class') AND weight=1.0)",
        "sm1 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY location, ord) rn, count(*) OVER (PARTITION BY project_id) n FROM sm0 WHERE same=1)",
        "sample AS MATERIALIZED (SELECT project_id, ord, name, location FROM sm1 WHERE (rn-1)%greatest(1,n//25)=0 AND (rn-1)//greatest(1,n//25)<25)",
    ]
    n, l = "r", "v"  # noqa: E741
    return {
        "tokenize_terms": _with([C, T], "SELECT ord, array_to_string(tokens,' ') terms, len(tokens)::INT n FROM t"),
        "doc_term_counts": _with([C, *INDEX[:2]], "SELECT scope, term, count(*) df, sum(tf)::BIGINT tf FROM post GROUP BY ALL"),
        "chunk_weight": _with([C, HASHED[2]], "SELECT ord, weight::DOUBLE weight FROM cw"),
        "index_build": _with([C, *INDEX, *HASHED, *EDGES], "SELECT 'docs' part, count(*) entries FROM c UNION ALL SELECT 'postings', count(*) FROM post UNION ALL SELECT 'terms', count(*) FROM w UNION ALL SELECT 'vectors', count(*) FROM hv UNION ALL SELECT 'edges', count(*) FROM edges"),
        "bm25_topk": _with([C, Q, *INDEX, QUESTIONS, *_bm25("a", 20)], "SELECT query_id, ord, round(score,6) score, rank::INT rank FROM a_bm"),
        "hash_embed_topk": _with([C, Q, *INDEX[:1], *HASHED, QUESTIONS, _bm25("a", 20)[0], *_hash("a", 20)], "SELECT query_id, ord, round(score,6) score, rank::INT rank FROM a_hm"),
        "vector_topk": """SELECT query_id, ord, round(score,6) score, rank::INT rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) rank FROM
 (SELECT a.vec_id query_id, b.vec_id ord, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),9) score FROM embeddings a, embeddings b WHERE a.vec_id%100=0) WHERE score>0) WHERE rank<=10""",
        "vector_label_recall": """SELECT label, count(*) hits, round(avg((label=hit_label)::INT),6) same_label FROM (SELECT a.label, b.label hit_label, row_number() OVER (PARTITION BY a.vec_id
 ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),9) DESC, b.vec_id) rank FROM embeddings a, embeddings b WHERE a.vec_id%100=0 AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])>0) WHERE rank<=10 GROUP BY label""",
        "rrf_hybrid": _with(SEARCH, "SELECT query_id, ord, round(score,6) score, sources, frank::INT rank FROM a_fused"),
        "rrf_weighted": _with(SEARCH, "SELECT query_id, ord, round(score,6) score, sources, rank::INT rank FROM a_ranked"),
        "search_bm25": _with([C, Q, *INDEX, *HASHED, QUESTIONS, *_candidates("a", 60, "bm25"), *EDGES, *_hits("a", 5)], "SELECT query_id, pos::INT pos, ord, path, round(score,6) score, stage FROM a_hits"),
        "import_edges": _with([*LINKED, *EDGES], "SELECT scope, importer, target FROM edges"),
        "expand_unseen_files": _with(linked, "SELECT query_id, ord, path, nth_at::INT slot FROM a_s1"),
        "expand_sibling_dirs": _with(linked, "SELECT query_id, ord, path, nth_at::INT slot FROM a_s2"),
        "expand_references": _with(linked, "SELECT query_id, ord, path, nth_at::INT slot FROM a_s3"),
        "expand_full": _with(FULL, "SELECT query_id, pos::INT pos, ord, path, round(score,6) score, stage FROM a_hits"),
        "expand_imports": _with([*linked, *IMPORTED], "SELECT query_id, ord, path, nth_at::INT slot FROM a_s4"),
        "expand_linked": _with(
            [*linked, *IMPORTED],
            """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, nth_at)::INT pos, ord, path, round(score,6) score, stage FROM
 (SELECT * FROM a_b UNION ALL SELECT * FROM a_s3 UNION ALL SELECT * FROM a_s5)""",
        ),
        "dense_topk": _with([*DENSE, *_dense("a", 20)], "SELECT query_id, ord, round(score,6) score, rank::INT rank FROM a_hm"),
        "search_dense": _with([*DENSE, *INDEX, HASHED[2], *_candidates("a", 60, "vector", dense=True), *EDGES, *_hits("a", 5)], HITS),
        "search_dense_hybrid": _with([*DENSE, *INDEX, HASHED[2], *_candidates("a", 60, "hybrid", dense=True, bm25_weight=0.5), *EDGES, *_hits("a", 5)], HITS),
        "dense_refusals": _with(
            [C, "pv AS (SELECT DISTINCT provider FROM vectors WHERE provider IS NOT NULL)",
             "v0 AS (SELECT provider, content_hash, vec::DOUBLE[] v FROM vectors WHERE content_hash IS NOT NULL AND vec IS NOT NULL)",
             "vd AS (SELECT provider, arg_max(d, (n, d)) d FROM (SELECT provider, len(v) d, count(*) n FROM v0 WHERE len(v)>0 GROUP BY ALL) GROUP BY provider)",
             "vu AS (SELECT DISTINCT provider, content_hash FROM v0 JOIN vd USING (provider) WHERE len(v)=d AND len(list_filter(v, lambda x: NOT isfinite(x)))=0 AND list_max(list_transform(v, lambda x: abs(x)))>0)"],
            "SELECT pv.provider, c.project_id, count(DISTINCT c.content_hash) contents, count(DISTINCT c.content_hash) FILTER (vu.content_hash IS NULL) missing FROM c CROSS JOIN pv LEFT JOIN vu ON vu.provider=pv.provider AND vu.content_hash=c.content_hash GROUP BY ALL"),
        "extract_sections": _with(MARKDOWN, "SELECT DISTINCT doc_id, i::INT start_line, CASE WHEN parent IS NULL THEN title ELSE parent||' > '||title END AS name, parent FROM mu WHERE title<>''"),
        "extract_part_sizes": "SELECT 0::BIGINT too_long, 0::BIGINT blank, count(DISTINCT doc_id) documents FROM documents WHERE regexp_matches(text,'\\S')",
        "extract_functions": _with(FUNCTIONS, r"""SELECT ord, name, s::INT start_line, e::INT end_line, context, substr(sha256(context||chr(10)||chr(10)||array_to_string(rs[s:e],chr(10))),1,16) content_hash
 FROM (SELECT *, 'f'||ord||'.py > '||name||' (function)' context FROM (SELECT *, regexp_extract(text,'(?m)^(?:async )?def ([\p{L}_][\p{L}\p{N}_]*)',1) AS name FROM fn WHERE NOT bad))"""),
        "extract_errors": _with(FUNCTIONS, "SELECT ord%2=0 OR bad failed, count(*) files FROM fn GROUP BY ALL"),
        "hit_payload": _with([C, Q, *INDEX, *HASHED, QUESTIONS, *_candidates("a", 60, "bm25")], f"""SELECT query_id, rank::INT pos, location, kind, name, round_even(score,4) score, sources,
 '--- '||location||'  ['||kind||'] '||name||chr(10)||array_to_string(list_transform({_lines("coalesce(text,'')")}, lambda x, i: lpad((coalesce(start_line,1)+i-1)::VARCHAR, greatest(5,length((coalesce(start_line,1)+i-1)::VARCHAR))::INT, ' ')||' | '||x), chr(10)) block
 FROM a_ranked JOIN c USING (ord) WHERE rank<=3"""),
        "rerank_pool": _with([C, Q, *INDEX, *HASHED, QUESTIONS, *_candidates("a", 20, "bm25")], """SELECT query_id, ord, -length(coalesce(context,'')||chr(10)||chr(10)||coalesce(text,''))::DOUBLE score, sources||',rerank' sources,
 row_number() OVER (PARTITION BY query_id ORDER BY length(coalesce(context,'')||chr(10)||chr(10)||coalesce(text,'')), rank)::INT rank FROM a_ranked JOIN c USING (ord)"""),
        "cited_files": _with(CITED, "SELECT answer_id doc_id, string_agg(DISTINCT regexp_replace(citation,':[^:]*$',''), ',' ORDER BY regexp_replace(citation,':[^:]*$','')) files FROM cited GROUP BY answer_id"),
        "jsonl_round_trip": _with([C], "SELECT kind, count(*) chunks, sum(length(text))::BIGINT chars, count(signature) signatures, count(DISTINCT text) texts, sum(end_line)::BIGINT end_lines FROM c GROUP BY kind"),
        "token_totals": f"SELECT field, sum(n)::BIGINT tokens FROM (SELECT unnest(['characters','lines']) field, unnest([length(text), len({_lines('text')})]) n FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)) GROUP BY field",
        "narrow_query": _with([Q], f"SELECT id, {NARROW} narrowed FROM q"),
        "facets": _with([C, Q, *INDEX, *HASHED, QUESTIONS, *_candidates("a", 300), *_facets("a")],
            "SELECT query_id, directory, chunks, best_rank::INT best_rank, array_to_string(list_slice(symbols,1,3),',') symbols, array_to_string(list_slice(children,1,3),',') children, len(children)::INT children_total, facet_rank::INT facet_rank, directory||' · '||chunks||' parça'||CASE WHEN len(children)>0 THEN ' — '||array_to_string(list_slice(children,1,3),', ')||CASE WHEN len(children)>3 THEN ' +'||(len(children)-3) ELSE '' END WHEN len(symbols)>0 THEN ' — '||array_to_string(list_slice(symbols,1,3),', ') ELSE '' END AS label FROM a_facets"),
        "facet_query_terms": _with([C, Q, *INDEX, *HASHED, NARROWED, *_candidates("a", 300), *_facets("a")], "SELECT query_id, facet_rank::INT facet_rank, text AS refined FROM a_refined"),
        "facet_search_within": _with([C, Q, *INDEX, *HASHED, QUESTIONS, *_candidates("a", 300), *_facets("a")],
            "SELECT query_id, ord, pos::INT pos FROM (SELECT r.query_id, r.ord, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) pos FROM a_fr r JOIN a_facets f ON f.query_id=r.query_id AND facet_rank=1 WHERE r.dir=f.directory OR starts_with(r.dir, f.directory||'/')) WHERE pos<=8"),
        "facet_measure": _with(
            [C, Q, *INDEX, *HASHED, *EDGES, NARROWED, *_candidates("a", 300), *_facets("a"),
             "b_q AS (SELECT query_id, scope, text FROM a_q)", *_candidates("b", 60), *_hits("b", 8),
             "d_q AS (SELECT query_id||'#'||facet_rank query_id, q.project_id scope, r.text FROM a_refined r JOIN q ON q.id=r.query_id)", *_candidates("d", 60), *_hits("d", 8),
             "j AS (SELECT id query_id, unnest(expect_files) path FROM q)",
             "pl AS (SELECT DISTINCT query_id FROM b_hits JOIN j USING (query_id, path))",
             "mn AS (SELECT DISTINCT f.query_id FROM a_facets f JOIN j ON j.query_id=f.query_id AND (j.path=f.directory OR starts_with(j.path, f.directory||'/')))",
             "ce AS (SELECT DISTINCT j.query_id FROM d_hits d JOIN a_refined r ON r.query_id||'#'||r.facet_rank=d.query_id JOIN j ON j.query_id=r.query_id AND j.path=d.path UNION SELECT query_id FROM pl)",
             "x AS (SELECT q.id, q.id IN (SELECT query_id FROM pl) p, q.id IN (SELECT query_id FROM mn) m, q.id IN (SELECT query_id FROM ce) e, split FROM q)",
             "y AS (SELECT split, unnest([{'measure':'plain','hit':p},{'measure':'menu','hit':m},{'measure':'ceiling','hit':e}]) z FROM x)",
             "v AS (SELECT split, z.measure measure, count(*) n, sum(z.hit::INT)::BIGINT hits FROM y GROUP BY ALL)"],
            f"SELECT split, measure, n, hits, round({_wilson('hits', 'n')[0]},4) low, round({_wilson('hits', 'n')[1]},4) high FROM v"),
        "grep_substring": _with([C], "SELECT ord, location FROM c WHERE contains(lower(name),'ledger') OR contains(lower(text),'ledger')"),
        "chunk_lookup": _with([C], "SELECT project_id, location, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY project_id, location ORDER BY ord) rn FROM c WHERE location IS NOT NULL AND project_id IS NOT NULL) WHERE rn=1"),
        "stats_by_kind": _with([C], "SELECT kind, count(*) chunks FROM c GROUP BY kind"),
        "stats_top_files": _with([C], "SELECT project_id, path, count(*) chunks, min(ord) first_ord FROM c GROUP BY ALL ORDER BY chunks DESC, first_ord LIMIT 10"),
        "stats_text_length": _with([C], "SELECT count(*) chunks, (coalesce(sum(length(text)),0)//greatest(count(*),1))::BIGINT mean_chars, coalesce(sum(length(text)),0)::BIGINT chars FROM c"),
        "index_status": _with([C], "SELECT project_id, sum(n)::BIGINT chunks, string_agg(kind||'='||n, ', ' ORDER BY kind||'='||n) kinds, any_value(files) files FROM (SELECT project_id, kind, count(*) n FROM c GROUP BY ALL) JOIN (SELECT project_id, count(DISTINCT path) files FROM c GROUP BY ALL) USING (project_id) GROUP BY project_id"),
        "composition": _with([C], f"SELECT project_id, total, code, test, doc, round_even(100*code/total,0)::INT code_pct, round_even(100*test/total,0)::INT test_pct, round_even(100*doc/total,0)::INT doc_pct FROM (SELECT project_id, count(*) total, count(*) FILTER (role='code') code, count(*) FILTER (role='test') test, count(*) FILTER (role='doc') doc FROM (SELECT project_id, CASE WHEN kind='section' OR ends_with(lower(path),'.md') THEN 'doc' WHEN regexp_matches(path,'{TEST}') THEN 'test' ELSE 'code' END role FROM c) GROUP BY ALL)"),
        "language_signal": _with([C], "SELECT project_id, p turkish_pct, CASE WHEN p>=20 THEN 'hybrid' ELSE 'vector' END suggested_mode FROM (SELECT project_id, round_even(100*count(*) FILTER (regexp_matches(text,'[ğĞşŞıİçÇöÖüÜ]'))/count(*),0)::INT p FROM c GROUP BY ALL)"),
        "content_hash": _with([C], "SELECT ord, substr(sha256(coalesce(context,'')||chr(10)||chr(10)||coalesce(text,'')),1,16) computed, content_hash IS NOT DISTINCT FROM substr(sha256(coalesce(context,'')||chr(10)||chr(10)||coalesce(text,'')),1,16) same FROM c"),
        "missing_vectors": _with([C, PROVIDERS, "h AS (SELECT DISTINCT provider, content_hash FROM vectors WHERE vec IS NOT NULL AND content_hash IS NOT NULL)"],
            "SELECT DISTINCT pv.provider, c.content_hash FROM c CROSS JOIN pv WHERE (pv.provider, c.content_hash) NOT IN (SELECT (provider, content_hash) FROM h)"),
        "cost_estimate": _with([C, PROVIDERS, "e AS (SELECT content_hash, max(length(text)+length(coalesce(context,''))) s FROM c GROUP BY ALL)", "h AS (SELECT DISTINCT provider, content_hash FROM vectors WHERE vec IS NOT NULL)", "x AS (SELECT pv.provider, e.*, h.content_hash IS NOT NULL there FROM e CROSS JOIN pv LEFT JOIN h ON h.provider=pv.provider AND h.content_hash=e.content_hash)"],
            "SELECT provider, count(*) total, count(*) FILTER (there) cached, count(*) FILTER (NOT there) missing, coalesce(sum(s) FILTER (NOT there),0)::BIGINT characters, round_even(coalesce(sum(s) FILTER (NOT there),0)/4,0)::BIGINT tokens, round_even(coalesce(sum(s) FILTER (NOT there),0)/4/1e6*0.18,4) cost FROM x GROUP BY provider"),
        "cache_upsert": "WITH old AS (SELECT content_hash, max(len(vec)) d FROM vectors WHERE provider='hash' AND content_hash IS NOT NULL GROUP BY ALL), new AS (SELECT content_hash, max(len(vec)) d FROM vectors WHERE provider='lokal' AND content_hash IS NOT NULL GROUP BY ALL) SELECT content_hash, d FROM new UNION ALL SELECT content_hash, d FROM old WHERE content_hash NOT IN (SELECT content_hash FROM new)",
        "project_upsert": r"""WITH p AS (SELECT *, regexp_replace(regexp_replace(lower(name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') slug, row_number() OVER (PARTITION BY id ORDER BY chunks DESC NULLS LAST, added DESC NULLS LAST, repo) rn FROM projects)
 SELECT id, CASE WHEN slug='' THEN 'proje' ELSE slug END slug, repo, chunks, files, CASE WHEN mode IN ('bm25','vector','hybrid') THEN mode WHEN provider='hash' THEN 'hybrid' ELSE 'vector' END AS mode FROM p WHERE rn=1""",
        "question_split": _with([Q], "SELECT split, count(*) questions, sum(len(expect_files))::BIGINT files, count(*) FILTER (len(expect_symbols)>0) with_symbols FROM q GROUP BY split"),
        "eval_per_question": _with([*FULL, *PER_QUESTION], "SELECT question_id, split, set_name, expected, returned, rank::INT rank, symbols_found, found, round(coverage,6) coverage FROM pq"),
        "eval_report": _with([*FULL, *PER_QUESTION], _report("")),
        "eval_by_split": _with([*FULL, *PER_QUESTION], _report("split")),
        "eval_by_set": _with([*FULL, *PER_QUESTION], _report("set_name")),
        "smoke_sample": _with([C, HASHED[2], *sample], "SELECT project_id, ord, name, location FROM sample"),
        "smoke_test": _with([C, *INDEX, *HASHED, *EDGES, *sample, "a_q AS (SELECT ord::VARCHAR query_id, project_id scope, name AS text FROM sample)", *_candidates("a", 60), *_hits("a", 8),
            "g AS (SELECT DISTINCT query_id::BIGINT ord, location FROM a_hits JOIN c USING (ord))".replace("query_id::BIGINT ord", "h.query_id::BIGINT ord").replace("a_hits JOIN c USING (ord)", "a_hits h JOIN c ON c.ord=h.ord")],
            "SELECT project_id, count(*) total, count(g.ord) found, round(count(g.ord)/count(*),3) rate FROM sample s LEFT JOIN g ON g.ord=s.ord AND g.location=s.location GROUP BY project_id"),
        "extract_citations": _with(CITED, "SELECT answer_id doc_id, n::INT n, citation FROM cited"),
        "verify_citations": _with([C, *CITED, FILES,
            "ci AS (SELECT *, regexp_replace(citation,':[^:]*$','') path, try_cast(regexp_extract(citation,'([0-9]+)$',1) AS BIGINT) line FROM cited)",
            "ex AS (SELECT ci.*, f.n_lines exact_lines FROM ci LEFT JOIN files f ON f.scope=ci.scope AND f.path=ci.path)",
            "tails AS (SELECT scope, path candidate, array_to_string(list_slice(string_split(path,'/'),i,len(string_split(path,'/'))),'/') tail FROM (SELECT scope, path, unnest(range(1,len(string_split(path,'/'))+1)) i FROM files))",
            "ma AS (SELECT e.answer_id, e.scope, e.n, t.candidate, EXISTS (SELECT 1 FROM ci s WHERE s.answer_id=e.answer_id AND contains(s.path,'/') AND s.path=t.candidate) spelled FROM ex e JOIN tails t ON t.scope=e.scope AND t.tail=regexp_replace(e.path,'^/+','') WHERE e.exact_lines IS NULL)",
            "na AS (SELECT answer_id, scope, n, CASE WHEN count(*)=1 THEN min(candidate) WHEN count(*) FILTER (spelled)=1 THEN min(candidate) FILTER (spelled) END t FROM ma GROUP BY ALL)"],
            "SELECT e.answer_id, e.n::INT n, e.citation, CASE WHEN exact_lines IS NOT NULL THEN e.path ELSE f.path END target, coalesce(e.line BETWEEN 1 AND coalesce(exact_lines, f.n_lines), false) verified FROM ex e LEFT JOIN na ON na.answer_id=e.answer_id AND na.scope=e.scope AND na.n=e.n LEFT JOIN files f ON f.scope=na.scope AND f.path=na.t"),
        "source_window": _with([C, f"""ls AS (SELECT project_id, path, coalesce(start_line,1)+i-1 line_no, min(x[i]) text FROM (SELECT project_id, path, start_line, x, unnest(range(1,len(x)+1)) i FROM
 (SELECT project_id, path, start_line, {_lines("text")} x FROM c WHERE text IS NOT NULL)) GROUP BY ALL)""",
            "ct AS (SELECT DISTINCT project_id, path, start_line line FROM c WHERE start_line IS NOT NULL)"],
            "SELECT ct.project_id, ct.path, ct.line, line_no, ls.text FROM ct JOIN ls ON ls.project_id=ct.project_id AND ls.path=ct.path AND ls.line_no BETWEEN greatest(1,ct.line-6) AND ct.line+12"),
        "numbered_snippet": _with([C], f"SELECT ord, array_to_string(list_transform({_lines('text')}, lambda x, i: lpad((start_line+i-1)::VARCHAR, greatest(5,length((start_line+i-1)::VARCHAR))::INT, ' ')||' | '||x), chr(10)) body, CASE WHEN len({_lines('text')})>40 THEN array_to_string(list_slice({_lines('text')},1,40),chr(10))||chr(10)||'... ('||(len({_lines('text')})-40)||' more lines)' ELSE array_to_string({_lines('text')},chr(10)) END head FROM c WHERE text IS NOT NULL AND start_line IS NOT NULL"),
        "answer_metrics": _with([C, Q, *CITED, FILES,
            "fx AS (SELECT id, f, (project_id, f) IN (SELECT (scope, path) FROM files) there FROM (SELECT id, project_id, unnest(expect_files) f FROM q))",
            "an AS (SELECT id, count(*) cited, count(*) FILTER (NOT there) un FROM fx GROUP BY id)",
            "hh AS (SELECT q.id, coalesce(cited,0) cited, coalesce(un,0) un, coalesce(cited,0) hit, len(expect_files) expected FROM q LEFT JOIN an ON an.id=q.id)"],
            f"SELECT n, accuracy, round({_wilson('s','n')[0]},4) accuracy_low, round({_wilson('s','n')[1]},4) accuracy_high, file_coverage, citations_per_answer, unverified FROM (SELECT count(*) n, count(*) FILTER (hit>0) s, round(avg((hit>0)::INT),4) accuracy, round(avg(hit/expected),4) file_coverage, round(avg(cited),2) citations_per_answer, sum(un)::BIGINT unverified FROM hh)"),
        "token_cost": "SELECT lang, sum(length(text))::BIGINT fresh, round(sum(length(text))*1.0/1e6+count(*)*1.25/1e6+count(*)*0.1/1e6+count(*)*5.0/1e6,6) cost FROM (SELECT DISTINCT doc_id, lang, text FROM documents) WHERE text IS NOT NULL GROUP BY lang",
        "enrich_context_join": _with([C], "SELECT ord, CASE WHEN changed THEN substr(sha256(coalesce(ctx,'')||chr(10)||chr(10)||coalesce(text,'')),1,16) ELSE content_hash END content_hash, llm IS NOT NULL enriched FROM (SELECT ord, text, content_hash, s.sentence IS NOT NULL AND trim(s.sentence)<>'' changed, docstring llm0, CASE WHEN docstring IS NOT NULL AND trim(docstring)<>'' AND s.sentence IS NOT NULL AND trim(s.sentence)<>'' THEN s.sentence WHEN s.sentence IS NOT NULL AND trim(s.sentence)<>'' THEN s.sentence ELSE llm_context END llm, CASE WHEN s.sentence IS NOT NULL AND trim(s.sentence)<>'' THEN concat_ws(chr(10), context, s.sentence) ELSE context END ctx FROM c LEFT JOIN (SELECT content_hash, max(docstring) sentence FROM c WHERE docstring IS NOT NULL GROUP BY ALL) s USING (content_hash))"),
    }
