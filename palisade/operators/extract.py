"""Extraction: a file's text becomes prompts, by extension, in discovery order.

All of it is array functions over the file's lines, so extraction is one narrow projection. Windows
overlap on purpose; duplicates among findings are settled later by the prompts' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.normalise import normalised
from palisade.functions.regexes import has
from palisade.functions.utf16 import longer
from palisade.rules.model import is_skill

# Results depend on these patterns and numbers.
RAW_EXTS = (".prompt", ".txt", ".md")
CODE_EXTS = (".ts", ".js", ".tsx", ".jsx", ".py", ".go", ".rs", ".java", ".kt", ".kts", ".cs", ".php", ".rb", ".swift", ".vue", ".sh", ".bash", ".c", ".cpp", ".cc", ".h", ".hs")
PROMPT_KEY = r"""(?:^|["'])(?:system|prompt|instructions?|messages?|role|content|context|directive)(?:["']|\s*:)"""
ROLE_CONTENT = r"""\{\s*["']?role["']?\s*:\s*["'][^"']+["']\s*,\s*["']?content["']?\s*:"""
SYSTEM_PHRASE = r"(?:you are|your (role|task|job|purpose) is|do not|don't|never|always|must|system:|instructions?:|you must|as an? (ai|assistant|bot))"
RAW_UNITS, STRUCTURED_LINES, OBJECT_LINES, CHAT_LINES, TEMPLATE_LINES = 50, 21, 16, 6, 200
CODE_TRIGGERS = (
    r"""(?:execSync|execFile|spawnSync)\s*\(|(?:exec|spawn)\s*\(\s*[`"']""",
    r"messages\s*(?:\??\.)?\s*push\s*\(\s*\{",
    r"""(?:atob|btoa)\s*\(|\.toString\s*\(\s*['"]base64['"]\s*\)|Buffer\.from\s*\([^)]+,\s*['"]base64['"]""",
    r"JSON\.parse\s*\(",
    r"(?:marked\s*[.(]|marked\.parse\s*\(|markdownIt\s*[.(]|new\s+MarkdownIt|dangerouslySetInnerHTML\s*=)",
    r"""\beval\s*\(\s*(?!['"`\d{[])""",
    r"""type\s*:\s*['"`]image_url['"`]""",
    r"\.transcriptions\.create\s*\(|openai\.audio\.transcriptions",
    r"Tesseract\.createWorker\s*\(|vision\.textDetection\s*\(",
    r"window\.location\.(?:search|hash|href)|document\.cookie\b|document\.querySelector\s*\(|document\.getElementById\s*\(",
    r"@modelcontextprotocol\/sdk|StdioServerTransport|StdioClientTransport|SSEClientTransport|McpServer\b|CreateMessageRequestSchema",
    r"\.chat\.completions\.create\s*\(\s*\{|\.messages\.create\s*\(\s*\{",
)
_JVM, _SHELL, _C = (
    r"ChatLanguageModel|OpenAiChatModel|AnthropicChatModel|langchain4j|spring\.ai",
    r"curl.{0,60}api\.openai\.com|curl.{0,60}api\.anthropic\.com",
    r"llama_|openai_|curl.{0,40}openai",
)
LANGUAGE_TRIGGERS = {
    ".py": r"from openai import|import openai|from anthropic import|langchain|litellm|google\.generativeai|\.chat\.completions\.create|\.messages\.create|ChatOpenAI|ChatAnthropic|import pickle|import torch\b",
    ".go": r'go-openai|openai\.NewClient|anthropic\.NewClient|"github\.com\/sashabaranov\/go-openai"',
    ".rs": r"async_openai|openai::Client|use openai|anthropic::Client",
    ".java": _JVM, ".kt": _JVM, ".kts": _JVM,
    ".cs": r"OpenAIClient|AzureOpenAIClient|IChatCompletionService|SemanticKernel|ChatClient",
    ".php": r"OpenAI::client|->chat->completions|Anthropic::|use OpenAI",
    ".swift": r"OpenAI\(token:|OpenAIKit|Anthropic\.",
    ".rb": r"OpenAI::Client\.new|ruby-openai|Anthropic::Client",
    ".sh": _SHELL, ".bash": _SHELL,
    ".vue": r"openai|anthropic|\.chat\.completions|\.messages\.create|ChatOpenAI|langchain",
    ".c": _C, ".cpp": _C, ".cc": _C, ".h": _C,
    ".hs": r"openai-hs|anthropic-hs",
}

PROMPT = "struct<text:string,line_start:int,line_end:int,kind:string>"
PROMPTS = f"array<{PROMPT}>"


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)\z", 1), r"(?<=.)(\.[^.]*)\z", 1))


def _prompt(text, start, end, kind) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), F.lit(kind).alias("kind"))


def _windows(lines: Column, test, length: int, kind: str, order: int) -> Column:
    """A prompt of `length` lines from each line that passes, with its place in the discovery order."""
    rows = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("l"), i.alias("i"))), lambda r: test(r["l"]))
    end = lambda i: F.least(i + length, F.size(lines))
    return F.transform(rows, lambda r: F.struct(r["i"].alias("at"), F.lit(order).alias("o"), _prompt(F.array_join(F.slice(lines, r["i"] + 1, F.lit(length)), "\n"), r["i"] + 1, end(r["i"]), kind).alias("p")))


def _templates(lines: Column) -> Column:
    """Back-tick strings over several lines: a line with an odd number of back-ticks opens or closes one."""
    found = f"array<struct<at:int,o:int,p:{PROMPT}>>"
    start = F.struct(F.lit(-1).alias("open"), F.array().cast(found).alias("out"))

    def step(acc, r):
        odd = (F.length(r["l"]) - F.length(F.replace(r["l"], F.lit("`"), F.lit("")))) % 2 == 1
        inside = acc["open"] >= 0
        text = F.array_join(F.slice(lines, acc["open"] + 1, r["i"] - acc["open"] + 1), "\n")
        good = has(text, SYSTEM_PHRASE) | has(text, PROMPT_KEY)
        item = F.struct(r["i"].alias("at"), F.lit(0).alias("o"), _prompt(text, acc["open"] + 1, r["i"] + 1, "template-string").alias("p"))
        closing = inside & odd
        # a string that has taken more lines than allowed is dropped
        over = inside & ~odd & (r["i"] - acc["open"] + 1 > TEMPLATE_LINES)
        now = F.when(closing | over, F.lit(-1)).when(~inside & odd, r["i"]).otherwise(acc["open"])
        return F.struct(now.alias("open"), F.when(closing & good, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).cast(found).alias("out"))

    rows = F.transform(lines, lambda x, i: F.struct(x.alias("l"), i.alias("i")))
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def prompts_of(path: Column, content: Column, lines: Column, ext: Column) -> Column:
    """array<prompt> of one file, in discovery order."""
    none = F.array().cast(PROMPTS)
    whole = lambda kind: F.array(_prompt(content, F.lit(1), F.size(lines), kind))
    # lengths first: they tell most texts, without a search
    raw = F.when(longer(content, RAW_UNITS) | has(content, SYSTEM_PHRASE), whole("raw")).otherwise(none)
    skill = F.when(is_skill(path), whole("code-block")).otherwise(none)
    structured = F.transform(_windows(lines, lambda x: has(x, PROMPT_KEY), STRUCTURED_LINES, "object-field", 0), lambda r: r["p"])
    chat = _windows(lines, lambda x: has(x, ROLE_CONTENT), CHAT_LINES, "chat-message", 1)
    field = _windows(lines, lambda x: has(x, PROMPT_KEY) & ~has(x, ROLE_CONTENT), OBJECT_LINES, "object-field", 2)
    templates = F.when(content.contains("`"), _templates(lines)).otherwise(F.array())
    found = F.transform(F.array_sort(F.concat(templates, chat, field), lambda a, b: F.when(a["at"] * 3 + a["o"] < b["at"] * 3 + b["o"], -1).otherwise(1)), lambda r: r["p"])
    trigger = F.lit(False)
    for p in CODE_TRIGGERS:
        trigger = trigger | has(content, p)
    for e, p in LANGUAGE_TRIGGERS.items():
        trigger = trigger | ((ext == e) & has(content, p))
    code = F.concat(found, F.when(trigger, whole("code-block")).otherwise(none))
    structured_name = path.endswith(".json") | path.endswith(".yaml") | path.endswith(".yml")
    return (
        F.when(ext.isin(*RAW_EXTS), F.concat(raw, skill))
        .when(structured_name, structured)
        .when(ext.isin(*CODE_EXTS), code)
        .otherwise(raw)
        .cast(PROMPTS)
    )


def extract_prompts(files: DataFrame, keep: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """files (path, content) to (path, ext, prompt_ord, kind, text, line_start, line_end), texts normalised but for code.

    every: a file without prompts has a row of nulls."""
    src = files.select("path", *keep, F.coalesce("content", F.lit("")).alias("content"), extension(F.col("path")).alias("ext"))
    src = src.withColumn("lines", F.split("content", "\n", -1))
    found = prompts_of(F.col("path"), F.col("content"), F.col("lines"), F.col("ext"))
    # the outer form, as for the other one the optimiser infers a filter that extracts once more
    rows = src.select("path", *keep, "ext", F.posexplode_outer(found).alias("prompt_ord", "p"))
    rows = rows if every else rows.where("prompt_ord is not null")
    text = F.when(F.col("p.kind") == "code-block", F.col("p.text")).otherwise(normalised(F.col("p.text")))
    return rows.select("path", *keep, "ext", "prompt_ord", F.col("p.kind").alias("kind"), text.alias("text"), F.col("p.line_start").alias("line_start"), F.col("p.line_end").alias("line_end"))


__all__ = ["extension", "extract_prompts", "prompts_of"]
