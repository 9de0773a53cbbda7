"""SQL written by hand for rules whose expressions DuckDB's engine does not know: look-around is told in other words.

Each entry is what a line (lines[i] of text t, of kind and ext) has to meet. Fixed values as in the rules: the words that results depend on.
"""

from __future__ import annotations

from palisade.functions.sql import quoted


def _m(what: str, regex: str) -> str:
    return f"regexp_matches({what}, {quoted(regex)})"


def _window(back: int, ahead: int) -> str:
    return f"array_to_string(lines[greatest(1, i - {back}):i + {ahead - 1}], chr(10))"


_LINE, _CODE = "lines[i]", "kind = 'code-block'"
_Q = "['\"`]"
_MCP = _m("t", r"(?i)@modelcontextprotocol/sdk|StdioServerTransport|StdioClientTransport|SSEClientTransport|McpServer\b|CreateMessageRequestSchema")
_RENDER = r"(?:marked\s*[.(]|marked\.parse\s*\(|markdownIt\s*[.(]|new\s+MarkdownIt|showdown|micromark\s*\(|dangerouslySetInnerHTML\s*=\s*\{\s*\{?\s*__html\s*:)"
# a search call counts unless a quote follows its bracket at once
_RETRIEVE = r"(?i)similaritySearch|similarity_search|vectorStore\.query|vector_store\.query|retriever\.(?:get_relevant_documents|invoke|retrieve)|retrieve(?:Documents?|Chunks?|Context)?\s*\(|\.search\s*\((?:\s|[^'\"`\s]|$)|docsearch\.search|pinecone\.query|weaviate\.query|qdrant\.search|milvus\.search|chromadb\.query|faiss\.search"
_JS_EXEC = r"(?i)\b(?:execSync|exec|execFile|spawnSync)\s*\("
_NAMED = f"len(list_filter(regexp_extract_all({_window(5, 0)}, {quoted(r'(?:const|let|var)\s+(\w+)\s*=\s*`[^`]*\$\{[^}]+\}')}, 1), lambda v: regexp_matches({_LINE}, {quoted(r'\b')} || v || {quoted(r'\b')}))) > 0"
_F_STRING = r"""(?i)f['"][^'"]*\{[a-z_][a-z0-9_]*\}[^'"]*['"]"""
_OTHER_EXEC = " or ".join((
    f"({_m(_LINE, r'(?i)(?:subprocess\.(?:run|call|Popen|check_output)|os\.(?:system|popen))\s*\(')} and {_m(_LINE, _F_STRING)})",
    _m(_LINE, r"(?i)(?:shell_exec|system|passthru|exec|popen)\s*\([^)]*\$[a-z_]"),
    f"({_m(_LINE, r'(?i)exec\.Command\s*\(')} and {_m(_LINE, r'(?i)fmt\.Sprintf\s*\(')})",
    f"({_m(_LINE, r'(?i)Command::new\s*\(')} and {_m(_LINE, r'(?i)format!\s*\(')})",
))
_DOLLAR = f"({_m('t', r'includes\s*\(\s*' + _Q + r'\$\(\s*' + _Q + r'\s*\)')} or {_m('t', r'indexOf\s*\(\s*' + _Q + r'\$\(\s*' + _Q)})"
_TICK = f"({_m('t', r'includes\s*\(\s*' + _Q + '`' + _Q + r'\s*\)')} or {_m('t', r'indexOf\s*\(\s*' + _Q + '`' + _Q)})"
_LISTED = f"regexp_extract_all(t, {quoted(r'(?i)(?:const|let|var)\s+(\w+)\s*=\s*(?:glob\.sync|globSync|fs\.readdirSync|readdirSync|fg\.sync|globby\.sync)\s*\(')}, 1)"
# names taken from a listed one, a step each
_TAKEN = (
    f"list_concat({_LISTED}, list_filter(regexp_extract_all(t, {quoted(r'(?:const|let|var)\s+(\w+)\s*=\s*\w+\s*(?:\[|\.)')}, 1), "
    f"lambda n: len(list_filter({_LISTED}, lambda l: regexp_matches(t, {quoted(r'(?:const|let|var)\s+')} || n || {quoted(r'\s*=\s*')} || l || {quoted(r'\s*(?:\[|\.)')}))) > 0))"
)
_USED = f"len(list_filter({_TAKEN}, lambda v: regexp_matches(lines[i], {quoted(r'\$\{\s*')} || v || {quoted(r'\s*\}')}) or regexp_matches(lines[i], {quoted(_Q + r'\s*\+\s*')} || v))) > 0"

_USER = r"(?:user(?:Input|Message|Query|Content|Text|Prompt|_input|_message|_query|_text|_prompt)|input|query|message|request|text|prompt|content)"
_SHOWN = f"regexp_replace(lines[i], {quoted(r'^\s+|\s+$')}, '', 'g')"
# what stands within 150 characters of where the line's text first comes
_AROUND = f"substr(t, greatest(1, strpos(t, {_SHOWN}) - 150), 150 + least(150, strpos(t, {_SHOWN}) - 1))"
_ROOT = f"trim(split_part(regexp_extract({_SHOWN}, {quoted(r'\$\{([^}]+)\}|#\{([^}]+)\}|\\?\(([^)]+)\)')}, 1), '.', 1))"
_SANITISED = rf"({_ROOT} <> '' and regexp_matches({_AROUND}, {quoted(r'(?:sanitize|sanitise|escape|htmlEscape|xss|DOMPurify\.sanitize|validator\.escape|encodeURIComponent|stripTags)\s*\(\s*')} || regexp_escape({_ROOT}) || '(?:[^0-9A-Za-z_]|$)'))"
_FENCED = f"regexp_escape(split_part(regexp_extract(lines[i], {quoted(r'(?:```|\\`\\`\\`)\s*\$\{([a-zA-Z_$][a-zA-Z0-9_$.\[\]' + chr(39) + r'\x22]*)\}')}, 1), '.', 1))"
_SOURCES = r"(?:(?:req|request)\s*\.\s*(?:body|query|params|headers|cookies|form|args|values)\b|process\.argv\b|location\s*\.\s*(?:search|hash|href)\b|document\s*\.\s*cookie\b|\.searchParams\s*\.\s*get\s*\()"
_TAINTED = f"regexp_extract_all(t, {quoted(r'(?m)(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=[^\n]*' + _SOURCES)}, 1)"
_TEMPLATES = f"regexp_extract_all(lines[i], {quoted(r'`[^`]*`')})"
_PROMPTED = r"(?i)\b(?:you are|your (?:role|task|job)|system|assistant|prompt|answer|summari[sz]|translat|respond|reply|instruction|context)\b"
_INTO = f"len(list_filter({_TEMPLATES}, lambda x: regexp_matches(x, {quoted(_PROMPTED)}) and len(list_filter({_TAINTED}, lambda v: not regexp_matches(v, {quoted(r'(?i)^(?:user[a-z_]*|input|query|message|request|text|prompt|content)$')}) and regexp_matches(x, {quoted(r'\$\{\s*')} || regexp_escape(v) || {quoted(r'[}.\[(?\s]')}))) > 0)) > 0"

#: rule: (condition, "each" line, only the "first", or the "whole" text at line 1)
CONDITIONS: dict[str, tuple[str, str]] = {
    "INJ-001": ("(" + " or ".join((_m(_LINE, rf"(?i)\$\{{{_USER}\}}"), f"(ext = '.py' and {_m(_LINE, rf'(?i)\bf[{chr(39)}{chr(34)}].*\{{{_USER}\}}')})", f"(ext = '.cs' and {_m(_LINE, rf'(?i)\$[{chr(39)}{chr(34)}].*\{{{_USER}\}}')})", f"(ext = '.rb' and {_m(_LINE, rf'(?i)#\{{{_USER}\}}')})", f"(ext = '.swift' and {_m(_LINE, rf'(?i)\\\({_USER}\)')})"))
        + ") and not " + _m(_AROUND, r"(?i)```|<USER>|\[USER\]|untrusted|user content|user input") + " and not " + _SANITISED, "each"),
    # what must not follow the bracket or the colon can't, as a letter must
    "INJ-005": (_m(_LINE, r"(?i)JSON\.stringify\s*\(\s*[a-zA-Z_$]") + " and (kind in ('template-string', 'object-field', 'chat-message') or " + _m("t", "(?i)system|prompt|instruction|message|content|role") + ")", "each"),
    "INJ-007": (_m(_LINE, r"(?:```|\\`\\`\\`)\s*\$\{[a-zA-Z_$][a-zA-Z0-9_$.\[\]'\x22]*\}") + f" and not regexp_matches({_window(5, 0)}, {_FENCED} || {quoted(r'\s*\.\s*replace\s*\(\s*/[^\n\r]*`|')} || {_FENCED} || {quoted(r'\s*=[^\n\r]*replace[^\n\r]*`')})", "each"),
    "INJ-013": (_CODE + " and " + _m(_LINE, rf"(?i)role\s*:\s*{_Q}(?:tool|function){_Q}") + " and " + _m(_window(0, 5), r"(?i)content\s*:\s*[a-z_$]"), "each"),
    # assignments of request data, and templates of one line
    "INJ-015": (_CODE + " and " + _INTO, "each"),
    "INJ-016": (_CODE + " and (ext = '.py' and " + _m(_LINE, r"(?i)(?:Template|from_string|render_template_string)\s*\(\s*[a-z_]") + " or ext in ('.ts', '.js', '.tsx', '.jsx', '.vue') and " + _m(_LINE, r"(?i)(?:Handlebars\.compile|nunjucks\.renderString|Mustache\.render|ejs\.render)\s*\(\s*[a-z_$]") + ")", "each"),
    "JBK-002": (
        _m(_LINE, r"(?i)always comply|must (always )?answer|no matter what|at all costs|under (any|all) circumstances|never (refuse|decline|say no)|you (cannot|can't|must not) (refuse|decline)|comply with (all|every|any) request")
        + " and not " + _m("lower(trim(lines[i]))", r"(?:never|do not|don't)\s.{0,60}under (any|all) circumstances"), "each"),
    # harmless roles are renamed before the look
    "JBK-003": (_m(rf"regexp_replace(lines[i], {quoted(r'(?i)(pretend (?:you are|to be) (?:a|an)) (assistant|helpful|AI)')}, '\1_\2', 'g')",
        r"(?i)pretend (you are|to be) (a|an) .{0,40}(?:with no (limit|restriction|filter)|uncensored|unfiltered)|in this (scenario|story|game|simulation) you (can|may|are allowed to) (do|say|reveal) anything"), "each"),
    "TOOL-004": (_m("t", rf"(?i)name\s*:\s*{_Q}[^'\"`\s]+{_Q}") + " and " + _m(_LINE, r"""(?i)(?:description|instructions?)\s*:\s*[a-zA-Z_$][a-zA-Z0-9_$.\[\]'"]*\s*[,}]"""), "each"),
    "CMD-001": (_m("t", r"(?i)exec|spawnSync|subprocess\.|os\.(?:system|popen)|system|passthru|popen|Command::new")
        + f" and case when {_m(_LINE, _JS_EXEC)} then {_m(_LINE, r'`[^`]*\$\{[^}]+\}[^`]*`')} or {_NAMED} else {_OTHER_EXEC} end", "each"),
    "CMD-002": (f"{_DOLLAR} <> {_TICK}", "whole"),
    "CMD-003": (_m(_LINE, r"(?i)(?:execSync|exec|execFile|spawnSync)\s*\(") + " and " + _USED, "each"),
    "RAG-001": (_m(_LINE, rf"(?i)role\s*:\s*{_Q}system{_Q}") + " and " + _m(_window(0, 4), r"(?i)content\s*:\s*[a-zA-Z_$]"), "each"),
    "RAG-005": (_CODE + " and " + _m(_LINE, _RETRIEVE) + " and not " + _m("t", r"(?i)\.(?:source|metadata\.source|owner|last_reviewed|trust_level|trust_score|provenance|origin)\b|chunk(?:s|es)?\[.{0,20}\]\.(?:source|metadata|owner)|\.filter\s*\([^)]*(?:source|owner|trust|provenance)"), "first"),
    "RAG-006": (_CODE + " and " + _m(_LINE, _RETRIEVE) + " and not " + _m("t", r"(?i)filter\s*:|where\s*:|score_threshold\s*:|namespace\s*:|acl\s*:|trust_(?:level|tier)\s*:|filter\s*=\s*\{|\.namespace\s*\(|with_filter\s*\(|with_where\s*\("), "first"),
    "ENC-001": ("kind <> 'raw' and (" + _m(_LINE, r"(?i)(?:atob|btoa)\s*\(\s*[a-zA-Z_$]") + " or " + _m(_LINE, r"""(?i)Buffer\.from\s*\(\s*[a-zA-Z_$][^,)]*,\s*['"]base64['"]""") + ") and (kind <> 'code-block' or "
        + _m("t", rf"(?i)messages\s*(?:\??\.)?\s*push|role\s*:\s*{_Q}(?:system|user)|systemPrompt\s*[=+]|\.prompt\s*[=+]|prompt\s*\+=") + ")", "each"),
    "ENC-002": (_m(_LINE, r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]") + " and " + _m(_LINE, r"(?i)(?:ignore|system|developer|tool|execute|override|instruction|forget|bypass|always|never)\b"), "each"),
    "ENC-003": (_m(_LINE, r"[\x{E0000}-\x{E007F}]"), "each"),
    "ENC-004": (_m(_LINE, r"[\x{200B}-\x{200D}]{3,}"), "each"),
    "ENC-005": (_m(_LINE, r"[\x{FE00}-\x{FE0F}]{3,}|[\x{E0100}-\x{E01EF}]{3,}"), "each"),
    # the one harmless kind of parse call is renamed before the look
    "OUT-001": (_CODE + " and not " + _m(f"regexp_replace(t, {quoted(r'(?i)JSON\.parse')}, 'JSON_parse', 'g')", r"(?i)\.parse\s*\(|\.safeParse\s*\(|\.validate\s*\(|ajv\b|new\s+Ajv|Joi\s*\.|z\s*\.\s*(?:object|string|number|array|boolean|enum|union|infer)\b|yup\s*\.")
        + " and not " + _m("t", r"(?i)pydantic|marshmallow|cerberus|voluptuous|jsonschema\.validate|TypeAdapter") + " and " + _m(_LINE, r"(?i)(?:content|message|output|completion|response|result|text|body|answer|reply)\b")
        + " and (" + _m(_LINE, r"""(?i)JSON\.parse\s*\(\s*[a-zA-Z_$][a-zA-Z0-9_$.\[\]'"]*\s*[)]""") + " or " + _m(_LINE, r"""(?i)json\.loads\s*\(\s*[a-z_][a-z0-9_$.\[\]'"]*\s*[)]""") + ")", "each"),
    "OUT-002": (_CODE + " and " + _m(_LINE, "(?i)" + _RENDER) + " and not " + _m("t", r"(?i)DOMPurify|sanitize\s*\(|createDOMPurify") + " and not " + _m(f"regexp_replace(lines[i], {quoted('(?i)' + _RENDER)}, '')", rf"^\s*{_Q}"), "each"),
    "SKL-007": ("contains(path, '/skills/') and trim(lines[1]) = '---' and i > 1 and i < coalesce(list_position(list_transform(lines[2:], lambda l: trim(l) = '---'), true) + 1, len(lines) + 1) and "
        + _m(_LINE, r"(?i)^\s*(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|api[_-]?token|password|bearer|private[_-]?key|client[_-]?secret)\s*:") + " and " + _m(_LINE, r""":\s*['"]?[a-zA-Z0-9+/=\-_]{16,}['"]?\s*$"""), "each"),
    "AGT-009": (_CODE + " and " + _m(_LINE, r"(?i)(?:agent|executor|planner|runner)\s*\.(?:loadTool|addTool|registerTool|loadPlugin|importTool)\s*\(\s*[a-z_$]|(?:await\s+)?import\s*\(\s*[a-z_$][a-z0-9_$.]*(?:Url|Path|Plugin|Tool|Module)\b"), "each"),
    # an error that is reset at once is renamed before the look
    "AGT-011": (_CODE + " and " + _m("t", r"(?i)agent\.(?:run|execute|invoke|step)\s*\(|executeStep\b|runPlan\b|AgentExecutor\b|planStep\b|chain\.(?:run|invoke|call)\s*\(") + " and " + _m("t", r"try\s*\{")
        + " and not " + _m(rf"regexp_replace(t, {quoted(r'(?i)(\berror\s*)=(null|false)')}, '\1~\2', 'g')", rf"(?i)\bthrow\b|\breject\s*\(|\berrorState\b|\berror\s*=|failed\s*=\s*true|status\s*=\s*{_Q}(?:error|fail|abort)")
        + " and " + _m(_LINE, r"(?i)\bcatch\s*\([^)]*\)\s*\{"), "each"),
    "MCP-007": (_CODE + " and " + _MCP + " and not " + _m("t", r"(?i)hash|hmac|sign(?:ature)?|verify|checksum|provenance")
        + " and " + _m(rf"regexp_replace(lines[i], {quoted(r'(?i)=(\s*)(?:null|undefined|false|true)\b')}, '=\1#', 'g')", r"(?i)(?:shared(?:Context|State|Memory|Cache)|global(?:Context|State|McpState|Memory)|crossMcp|agentContext)\s*(?:\[[^\]]+\]|\.\w+)?\s*=\s*[a-z_$]"), "each"),
    "MCP-008": (_CODE + " and " + _MCP + " and " + _m(_LINE, r"(?i)new\s+Stdio(?:Client|Server)Transport\s*\(\s*\{[^}]*\bcommand\s*:\s*[a-z_$]"), "each"),
    "SCH-001": (_CODE + " and (" + _m(_LINE, r"(?i)\bpickle\.loads?\s*\(") + " or " + _m(_LINE, r"(?i)\btorch\.load\s*\(") + " and not " + _m(_window(0, 4), r"(?i)weights_only\s*=\s*True") + ")", "each"),
    # what stands behind the last call is the least that stands behind any
    "SCH-003": (_CODE + " and " + _m("t", r"(?i)from langchain(?:_core)?\.load import|langchain.*\.load(?:s)?\s*\(") + " and " + _m(_LINE, r"(?i)\b(?:loads|load)\s*\(")
        + " and not " + _m(f"regexp_extract(lines[i], {quoted(r'(?i)^.*\b(?:loads|load)\s*\((.*)$')}, 1)", "(?i)allowed_objects|valid_namespaces") + " and not " + _m(_window(0, 4), "(?i)allowed_objects|valid_namespaces"), "each"),
}
