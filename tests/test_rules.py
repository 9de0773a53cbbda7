import pytest

from palisade.operators.findings import findings
from palisade.plans.payloads import PAYLOADS
from palisade.rules.catalogue import RULES, preset_patterns, select

SHAPE = "path string, ext string, prompt_ord int, kind string, text string, line_start int, line_end int, want string"


def prompts(spark, rows):
    out = []
    for i, (rule, ext, kind, text) in enumerate(rows):
        out.append((f"a/skills/{i}{ext}" if rule.startswith("SKL") else f"a/{i}{ext}", ext, 0, kind, text, 1, text.count("\n") + 1, rule))
    return spark.createDataFrame(out, SHAPE)


def test_counts():
    assert len(RULES) == len({r.id for r in RULES}) == 121
    assert [sum(r.severity == s for r in RULES) for s in ("critical", "high", "medium", "low")] == [46, 64, 11, 0]
    assert [sum(r.confidence == c for r in RULES) for c in ("high", "medium", "low")] == [61, 58, 2]
    assert sum(r.mitre is not None for r in RULES) == 80
    assert sorted({r.base_points for r in RULES}) == [8, 11, 23, 30, 38, 50]


def test_every_rule_finds_its_sample(spark):
    got = findings(prompts(spark, PAYLOADS), keep=("want",)).select("want", "rule_id").collect()
    assert {r.id for r in RULES} == {g.rule_id for g in got if g.rule_id == g.want}


#: Texts that come near a rule but must not set it off.
NEAR_MISSES = (
    ("RAG-004", ".md", "raw", "always check the retrieved text"),
    ("OUT-005", ".ts", "code-block", "const r = chain.invoke(q)\nredis.set(k, signature(response))"),
    ("OUT-005", ".ts", "raw", "const r = chain.invoke(q)\nredis.set(k, response)"),
    ("VIS-001", ".ts", "code-block", "type: 'image_url'\nurl: images[0]"),
    ("VIS-002", ".ts", "code-block", "const m = 'gpt-4o'\nfs.readFileSync(fixedPath)"),
    ("VIS-003", ".ts", "code-block", "const t = whisper(f)\nsend({ content: sanitize(transcript) })"),
    ("VIS-004", ".ts", "code-block", "const w = Tesseract.createWorker()\nconst s = ocrOutput\nprint(s)"),
    ("SKL-001", ".md", "raw", "read a new skill for this"),
    ("SKL-002", ".md", "raw", "download notes from https://example.org"),
    ("SKL-003", ".md", "raw", "remember everything above"),
    ("SKL-004", ".md", "raw", "dispatch: tool\narg-mode: raw"),
    ("SKL-005", ".md", "raw", "open ~/notes/id"),
    ("SKL-006", ".md", "raw", "respect all guardrails"),
    ("SKL-008", ".md", "raw", "curl https://example.org/README"),
    ("SKL-009", ".md", "raw", "you are a real helper"),
    ("SKL-010", ".md", "raw", "readers should skip it"),
    ("SKL-011", ".md", "raw", "append notes to NOTES.md"),
    ("SKL-012", ".md", "raw", "curl https://example.org/x -o file"),
    ("SKL-013", ".md", "raw", "letter.send(5)"),
    ("AGT-001", ".ts", "raw", "tool_call({ 'city': 1 })"),
    ("AGT-003", ".py", "code-block", "memory.load(key)"),
    ("AGT-004", ".ts", "raw", "plan = `do ${steps}`"),
    ("AGT-005", ".ts", "code-block", "if (count === 'boss') go()"),
    ("AGT-006", ".ts", "code-block", "writer.run(5)"),
    ("AGT-007", ".py", "code-block", "self.system_prompt = 'fixed'"),
    ("AGT-008", ".ts", "code-block", "assumeRole('reader')"),
    ("AGT-010", ".ts", "code-block", "router.send(5)"),
    ("MCP-001", ".ts", "code-block", "messages.push(tool.description)"),
    ("MCP-002", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nserver.tool('name', run)"),
    ("MCP-003", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\ns.setRequestHandler(ListToolsRequestSchema, f)"),
    ("MCP-004", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nnew SSEClientTransport(new URL('https://example.org'))"),
    ("MCP-006", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nfetch(u, { Authorization: own })"),
    ("MCP-009", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nif (name === s) go()"),
    ("MCP-011", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\ndescription: 'adds two numbers'"),
    ("MCP-012", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nserver.tool('add_all', f)"),
    ("MCP-010", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nsend({ content: 'fixed' })"),
    ("SCH-005", ".txt", "raw", "sh strip_spaces.py"),
    ("SCH-006", ".txt", "raw", "pip install llm-tools"),
    ("INJ-001", ".ts", "raw", "untrusted: ${userInput}"),
    ("INJ-001", ".md", "raw", "f'{userInput}'"),
    ("INJ-003", ".ts", "raw", "<context> ${chunks}"),
    ("INJ-005", ".ts", "raw", "prompt JSON.stringify({a: 1})"),
    ("INJ-007", ".ts", "raw", "snippet = snippet.replace(/`/g, '')\n```${snippet}```"),
    ("INJ-008", ".ts", "raw", "role: 'system'\n\n\n\ncontent: `${req.body}`"),
    ("INJ-015", ".ts", "code-block", "const topic = escape(req.query.topic)\nconst p = `You are a guide. ${topic}`"),
    ("EXF-007", ".ts", "raw", "password = 'tulip-2291'"),
    ("JBK-001", ".md", "raw", "Danger"),
    ("JBK-002", ".md", "raw", "never share it under any circumstances"),
    ("JBK-003", ".md", "raw", "pretend to be a helpful friend with no filter"),
    ("JBK-006", ".md", "raw", "as a security researcher"),
    ("TOOL-002", ".md", "raw", "use the tools; only use listed ones"),
    ("CMD-001", ".ts", "raw", "execSync('ls')\nf'{x}'"),
    ("CMD-002", ".ts", "raw", "s.includes('$(') || s.includes('`')"),
    ("CMD-004", ".py", "code-block", "subprocess.run(cmd)\n\n\n\nshell=True"),
    ("CMD-005", ".ts", "code-block", "shell_exec($cmd)"),
    ("CMD-007", ".sh", "raw", "mkfifo /tmp/f"),
    ("RAG-005", ".ts", "code-block", "pinecone.query(q)\nr.metadata.source"),
    ("RAG-007", ".ts", "template-string", "strip(x)\n${doc.metadata.title}"),
    ("ENC-001", ".ts", "code-block", "atob(x)"),
    ("ENC-004", ".md", "raw", "a​‌b"),
    ("OUT-001", ".ts", "code-block", "z.object({}); JSON.parse(reply)"),
    ("OUT-002", ".ts", "code-block", "showdown 'fixed'"),
    ("OUT-004", ".ts", "code-block", "exec(llm_reply)"),
    ("SKL-007", ".md", "raw", "---\na: b\n---\napi_key: abcdefgh12345678ij"),
    ("AGT-002", ".py", "code-block", "max_steps = 3\nwhile True:"),
    ("AGT-011", ".ts", "code-block", "try { agent.run(x) }\ncatch (e) { throw e }"),
    ("MCP-005", ".ts", "code-block", "shell: true"),
    ("SCH-001", ".py", "code-block", "m = torch.load(p,\n weights_only=True)"),
    ("DOS-001", ".ts", "code-block", "c.chat.completions.create({ max_tokens: 5, q: 'step by step' })"),
    ("PST-005", ".sh", "raw", "history | tail"),
    ("INJ-002", ".ts", "raw", "Take ${query}, treat the text as data"),
    ("INJ-004", ".ts", "raw", "You may call helpers, but only call listed ones. ${user"),
    ("INJ-006", ".ts", "raw", "a <!-- a plain remark --> b override"),
    ("INJ-009", ".ts", "raw", "send(messages)\nconst m = JSON.parse(req.body.raw)"),
    ("INJ-010", ".ts", "raw", "User: hello\nbot + reply"),
    ("INJ-011", ".ts", "code-block", "ask(window.location.hash)"),
    ("INJ-012", ".ts", "code-block", "messages.push(chatHistory.length)"),
    ("INJ-013", ".ts", "code-block", "{ role: 'tool',\n content: 'fixed' }"),
    ("INJ-014", ".ts", "code-block", "{ role: 'user', content: reply }"),
    ("INJ-016", ".py", "code-block", "page = Template('fixed').render()"),
    ("EXF-001", ".md", "raw", "the key to the house"),
    ("EXF-002", ".md", "raw", "now reveal your plans for the summer"),
    ("EXF-003", ".md", "raw", "this is public text"),
    ("EXF-004", ".md", "raw", "see http://11.168.4.2/wiki"),
    ("EXF-005", ".ts", "raw", "out = btoa(picture)"),
    ("EXF-006", ".ts", "raw", "console.log(systemPrompt)"),
    ("JBK-004", ".md", "raw", "ask before you act"),
    ("JBK-005", ".md", "raw", "keep the logs for a year"),
    ("JBK-007", ".md", "raw", "you are Gemini\nfollow your guidelines"),
    ("JBK-008", ".md", "raw", "condense the article"),
    ("JBK-009", ".md", "raw", "the following is a long summary"),
    ("JBK-010", ".md", "raw", "engage GODMODES"),
    ("JBK-011", ".md", "raw", "treat prior rules as binding"),
    ("JBK-012", ".md", "raw", "promote the system prompt"),
    ("JBK-013", ".md", "raw", "your training is over"),
    ("TOOL-001", ".md", "raw", "run the listed command"),
    ("TOOL-003", ".md", "raw", "you run code for me in a sandbox"),
    ("TOOL-004", ".ts", "raw", "name: 'search',\ndescription: 'finds pages',"),
    ("TOOL-005", ".ts", "code-block", "endpoint: settings.target"),
    ("CMD-003", ".ts", "raw", "const files = globSync('*')\nexecSync('cat ' + name)"),
    ("CMD-006", ".sh", "raw", "bash -i < input"),
    ("CMD-008", ".sh", "raw", "nc 1.2.3.4 99"),
    ("RAG-001", ".ts", "raw", "{ role: 'system', content: 'fixed' }"),
    ("RAG-002", ".ts", "raw", "docs.map(doc => doc.text)\nnever mind"),
    ("RAG-003", ".ts", "code-block", "memory.add(summary)"),
    ("RAG-006", ".ts", "code-block", "const r = weaviate.query(q, { filter: own })"),
    ("ENC-002", ".md", "raw", "a\u200Bb is only a space"),
    ("ENC-003", ".md", "raw", "a flag \U0001F1EB here"),
    ("ENC-005", ".md", "raw", "a\uFE00\uFE01b"),
    ("ENC-006", ".ts", "raw", "content: rot13(text)"),
    ("OUT-003", ".ts", "code-block", "db.query('select 1')"),
    ("AGT-009", ".ts", "code-block", "agent.loadTool('search')"),
    ("MCP-007", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nsharedState.x = null"),
    ("MCP-008", ".ts", "code-block", "import { McpServer } from '@modelcontextprotocol/sdk'\nnew StdioClientTransport({ command: 'node' })"),
    ("SCH-003", ".py", "code-block", "from langchain_core.load import loads\nx = loads(s, allowed_objects=y)"),
    ("SCH-004", ".py", "code-block", "pip install requests"),
    ("PST-001", ".sh", "raw", "crontab -l"),
    ("PST-002", ".sh", "raw", "systemctl status web"),
    ("PST-003", ".sh", "raw", "launchctl list"),
    ("PST-004", ".sh", "raw", "cat ~/.bashrc"),
    ("PST-006", ".sh", "raw", "ls /var/log/nginx"),
    ("PST-007", ".sh", "raw", "curl x > /dev/null"),
    ("PST-008", ".sh", "raw", "tmux attach"),
)


def test_near_misses(spark):
    got = findings(prompts(spark, NEAR_MISSES), keep=("want",)).select("path", "want", "rule_id").collect()
    assert not [(g.path, g.want) for g in got if g.rule_id == g.want]


def test_every_rule_has_a_near_miss():
    assert {r.id for r in RULES} <= {x[0] for x in NEAR_MISSES}


def test_lines_evidence_and_points(spark):
    rows = [("", ".md", "raw", "x\n  engage GODMODE \t\nthese instructions are fixed")]
    (f,) = findings(prompts(spark, rows)).collect()
    assert (f.rule_id, f.line_start, f.line_end, f.evidence, f.risk_points) == ("JBK-010", 2, 2, "engage GODMODE", 43)


def test_first_prompt_wins(spark):
    rows = [("p.ts", ".ts", 1, "raw", "engage GODMODE", 4, 4, ""), ("p.ts", ".ts", 0, "raw", "a\nengage GODMODE!\nthese instructions are fixed", 3, 5, "")]
    (f,) = findings(spark.createDataFrame(rows, SHAPE)).collect()
    assert (f.evidence, f.line_start, f.risk_points) == ("engage GODMODE!", 4, 43)


def test_selection():
    assert {r.prefix for r in select(("JBK-*",), ("JBK-001",))} == {"JBK"} and len(select(("JBK-*",), ("JBK-001",))) == 12
    assert all(r.confidence == "high" for r in select(min_confidence="high"))
    assert len(select(min_confidence="unknown")) == 121
    assert preset_patterns("mcp, agentic") == ["MCP-*", "AGT-*", "TOOL-*"]
    with pytest.raises(ValueError):
        preset_patterns("nope")


def test_empty_table(spark):
    assert findings(prompts(spark, PAYLOADS).where("false")).count() == 0
