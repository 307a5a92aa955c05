"""Word lists, weights, limits and labels that results depend on.

Every operator takes them as arguments with these as defaults, so another vocabulary can be put in.
"""

# Searchable files
TEXT_SUFFIXES = [".py", ".ts", ".tsx", ".js", ".jsx", ".json", ".md", ".txt", ".yaml", ".yml", ".toml", ".css", ".html", ".sql", ".sh", ".ps1"]
IGNORED_DIRECTORIES = [".git", ".idea", ".next", ".vscode-test", "__pycache__", "dist", "node_modules", "out", "build", ".venv", "venv"]
MAX_SCANNED_FILES = 650
MAX_FILE_BYTES = 120_000

# Scope and documentation words of a prompt
PROJECT_SCOPE_WORDS = ["整个项目", "项目级", "工程级", "工作区", "多文件", "多个文件", "项目代码", "codebase", "workspace", "project", "multiple files", "across files"]
DOCUMENTATION_WORDS = ["文档", "说明", "readme", "论文", "架构", "docs", "documentation"]
CREATION_WORDS = ["新建", "新增", "创建", "create", "add", "new file"]
CODE_CHANGE_WORDS = ["代码", "功能", "修复", "优化", "重构", "实现", "bug", "class", "function", "python", "backend", "插件", "webview", ".py", ".ts", ".tsx", ".js"]
OPTIONAL_DOCUMENTATION_WORDS = ["必要时", "如果需要", "视情况", "可选", "if needed", "if necessary", "optionally"]

# Words that route a prompt to a change of the workspace
WORKSPACE_STRONG_WORDS = [
    "修改项目", "更新项目", "优化项目", "优化工程", "整个工程", "整个项目", "实现这个功能", "直接修改", "应用修改", "生成变更", "待确认的项目级修改方案", "新增文件", "创建文件", "创建一个新文件",
    "更新文档", "修改文档", "更新readme", "修改readme", "更新说明", "重构项目", "修改这个项目", "create a new file", "update the project", "modify the project", "optimize the project",
    "update readme", "update documentation", "create file", "apply changes",
]
WORKSPACE_VERBS = ["修改", "更新", "新增", "创建", "重构", "实现", "补充", "修复", "改造", "优化", "编写", "change", "update", "create", "add", "implement", "rewrite", "refactor", "fix", "optimize"]
WORKSPACE_TARGETS = ["项目", "文件", "文档", "工程", "目录", "模块", "readme", "说明", "代码", "功能", "project", "workspace", "codebase", "module", "directory", "file", "documentation", "docs"]
WORKSPACE_HISTORY_WORDS = ["项目", "工作区", "多文件", "readme", "docs", "文档", "project", "workspace", "codebase"]

# Words that route a prompt to a direct edit of the current file
EDIT_VERBS = ["修改", "改写", "重构", "优化", "修复", "调整", "补全", "完善", "改成", "替换", "封装", "抽取", "拆分", "整理", "继续", "edit", "modify", "rewrite", "refactor", "improve", "fix", "update"]
EDIT_TARGETS = [
    "当前文件", "这个文件", "本文件", "当前代码", "这段代码", "选中代码", "选中的代码", "当前函数", "这个函数", "该函数", "当前方法", "这个方法", "该方法", "这个类", "该类",
    "current file", "this file", "current code", "selected code", "current function", "current method", "current class",
]
EDIT_WORKSPACE_WORDS = ["整个项目", "项目级", "工作区", "多文件", "多个文件", "readme", "docs", "文档", "project", "workspace", "codebase", "multiple files"]
EDIT_REQUEST_WORDS = ["帮我", "请帮我", "请直接", "直接", "开始", "把", "将", "替我", "帮忙", "please"]
EDIT_INQUIRY_WORDS = ["我想知道", "想知道", "解释一下", "请解释", "分析一下", "这个函数是干什么的", "什么作用", "什么意思", "为什么", "可以继续封装吗", "能不能继续封装"]
EDIT_HISTORY_WORDS = ["函数", "方法", "类", "当前文件", "选中代码", "load_students", "function", "method", "class", "current file", "selected code"]
EDIT_CONTINUATION_WORDS = ["继续", "进一步", "接着", "顺手", "继续把"]
MULTI_FILE_WORDS = ["多个文件", "多文件", "readme", "docs", "文档", "工作区", "workspace", "整个项目", "项目级", "新增文件", "创建文件"]

# Search score
BACKEND_WORDS = ["后端", "python", "ollama", "service", "agent"]
INTERFACE_WORDS = ["前端", "界面", "插件", "vscode", "webview", "panel", "ui"]
CONFIG_WORDS = ["配置", "依赖", "环境", "requirements", "package", "conda", "lora", "model"]
CONFIG_FILES = ["package.json", "requirements.txt", "environment.yml", "model_profiles.json"]
PROJECT_SUFFIXES = [".py", ".ts", ".tsx", ".js", ".md", ".json"]
SEARCH_WEIGHTS = {"active": 120, "active_in_project": 40, "sibling": 18, "sibling_in_project": 10, "term": 12, "documentation": 32, "area": 24, "project_suffix": 6, "readme": 8, "docs": 6}
SEARCH_LABELS = {
    "active": "当前活动文件", "sibling": "与当前活动文件位于同一目录", "term": "路径命中关键词 ", "documentation": "与文档更新需求相关", "backend": "与后端或 Agent 逻辑相关", "interface": "与插件界面相关",
    "config": "与项目配置相关", "project": "适合作为项目级上下文", "readme": "项目入口说明文件", "docs": "文档目录", "none": "工作区候选文件",
}
LABEL_SEPARATOR = "；"
SEARCH_FILES, SEARCH_FILES_IN_PROJECT, SEARCH_PER_DIRECTORY, OVERVIEW_FILES = 6, 9, 2, 15
EXCERPT_CHARS, REPORT_EXCERPT_CHARS, FULL_CONTENT_CHARS = 1800, 1200, 6000
EXCERPT_MARK, REPORT_EXCERPT_MARK = "\n...[truncated by workspace search]", "\n...[truncated by tool]"

# Tokens and ranking
ASCII_TOKEN, CJK_RUN, PATH_TERM = "[a-zA-Z_][a-zA-Z0-9_./-]{1,}", "[一-鿿]{2,}", "[a-zA-Z_][a-zA-Z0-9_./-]{2,}"
STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "please", "help", "project", "workspace", "file", "files", "code", "agent",
    "当前", "这个", "那个", "一下", "帮我", "请你", "需要", "项目", "工程", "文件", "代码", "整个项目", "工作区",
]
ALIASES = {
    "报表": ["report", "format", "line", "summary"], "报告": ["report", "summary"], "平均分": ["average", "avg", "score"], "成绩": ["score", "student", "record"], "学生": ["student", "record"],
    "数据": ["data", "record", "json"], "加载": ["load", "read", "storage", "path"], "读取": ["read", "load", "json", "storage"], "保存": ["save", "write", "storage"], "存储": ["storage", "json", "path"],
    "模型": ["model", "record", "entity"], "管理": ["manager", "service"], "统计": ["report", "summary", "average"],
}
MARKDOWN_PENALTY, SEMANTIC_MATCHES, MATCH_KEYWORDS, QUERY_TERMS = 0.72, 4, 3, 8

# Risk of a change
RISK_CODE_SUFFIXES = [".py", ".ts", ".tsx", ".js", ".jsx", ".json", ".yaml", ".yml", ".toml"]
SIGNATURE_LINE, IMPORT_LINE = r"(?m)^\s*(?:def|class|async def|function|interface|type)\s+", r"(?m)^\s*(?:import|from)\s+"
RISK_WEIGHTS = {"create": 18, "documentation": 4, "update": 8, "code": 10, "each_more": 6, "most_more": 18, "directories": 8, "signature": 20, "import": 10, "large": 12, "not_active": 6, "documentation_relief": 8}
RISK_BATCH = {"each_more": 6, "each_directory": 4, "most": 100}
RISK_LABELS = {
    "create": "包含新增文件", "documentation": "当前动作主要修改文档", "update": "包含现有文件改写", "code": "目标是源代码或配置文件", "directories": "修改跨越多个目录", "signature": "检测到函数或类型签名变化",
    "import": "检测到导入关系变化", "large": "文件改动规模较大", "not_active": "目标文件不是当前活动文件",
}
RISK_MANY, SIGNATURE_WORD = ("本次方案涉及 ", " 个文件"), "签名变化"
RISK_TAGS = {"low": "[低风险]", "medium": "[中风险]", "high": "[高风险]"}
DEFAULT_SUMMARIES = {"create_file": "新增文件 ", "update_documentation": "更新文档 ", "other": "修改文件 "}
RISK_HIGH, RISK_MEDIUM = 65, 30
LARGE_NEW_LINES, LARGE_DELTA_LINES, LARGE_DELTA_SHARE = 30, 40, 0.35

# actions
KIND_ALIASES = {
    "create": "create_file", "create_file": "create_file", "new_file": "create_file", "add_file": "create_file", "update": "update_file", "update_file": "update_file", "modify_file": "update_file",
    "rewrite_file": "update_file", "update_current_file": "update_file", "update_documentation": "update_documentation", "documentation": "update_documentation", "update_docs": "update_documentation",
    "update_readme": "update_documentation", "update_doc": "update_documentation",
}
DOCUMENTATION_SUFFIXES = [".md", ".rst", ".txt"]
SOURCE_STARTS = ["import ", "from ", "class ", "def ", "function ", "const ", "let ", "interface ", "public class ", "#include "]
SOURCE_FENCES = ["```python", "```ts", "```javascript"]
INCOMPLETE_WORDS = ["not shown due to brevity", "omitted", "placeholder", "full code not shown", "此处省略", "省略", "todo"]
LEFT_TAGS = ["<p>", "<summary>", "<updated_content>"]
EXPLICIT_PATH, PATH_TRIM = r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+", " \t\r\n,.;:，。；：)[]{}<>"
KNOWN_TAGS = ["assistant_reply", "proposal_summary", "actions", "action", "kind", "target_file", "summary", "updated_content", "updated_file"]
PLANNED, PLANNED_IN_PROJECT, PLANNED_PER_DIRECTORY, PARSED_ACTIONS, SUMMARY_CHARS = 3, 5, 2, 8, 80

# Streams, diffs, conversations, profiles
FIRST_SNAPSHOT, NEXT_SNAPSHOT, LINE_SNAPSHOT = 24, 120, 48
DIFF_CONTEXT, DIFF_LINES = 2, 160
HISTORY_TURNS = 6
CHUNK_CHARS, FEWEST_CHUNKS, MOST_CHUNKS = 900, 4, 12
THINKING_WORD, ACTING_WORDS = "思考", ["应用", "写回", "执行"]
BUSY_WORDS, IDLE_WORDS = ["发送", "思考", "检索", "生成", "规划", "分析", "应用", "写回", "执行", "流式", "patch", "处理中"], ["待命", "已响应"]
CONTEXT_EXCERPT_CHARS, CONTEXT_FULL_CHARS = 4000, 18000
LONG_FUNCTION_LINES, MANY_PRINTS, LONG_FILE_LINES = 25, 3, 220
GRADES = [(90, "A"), (80, "B"), (70, "C")]
PROPOSAL_LABELS = {"overall": "整体风险：", "planned": "共生成 ", "planned_end": " 个待确认变更"}

# Patterns of tagged text and of thoughts
THOUGHT, OPEN_THOUGHT, SUMMARY_BLOCK = r"(?s)<think>.*?</think>", r"(?s)<think>.*\z", r"(?is)<summary>.*?</summary>"
FILE_EDGES = [r"(?i)\A\s*<(?:updated_content|updated_file)>\s*", r"(?i)\s*</(?:updated_content|updated_file)>\s*\z", r"\A\s*```[^\n]*\n", r"\n```?\s*\z"]
WHOLE_FENCE, CODE_BLOCK = r"(?s)\A```[^\n]*\n(.*?)\n```\z", r"(?s)```[^\n]*\n(.*?)\n```"

# Texts that are shown
FALLBACK_FILES, FALLBACK_SCORE, FALLBACK_REASON = ["README.md", "backend/service.py", "src/extension.ts"], 10, "默认关键文件"
REASON_WITH_KEYWORDS, REASON_WITHOUT, KEYWORD_SEPARATOR = "语义命中关键词：", "语义相关度较高", "、"
NO_RANKING, QUERY_HEAD, MATCH_HEAD, RANKING_SUMMARY, SUMMARY_FILES = "(semantic retrieval unavailable)", "- Query concepts:", "- Semantic retrieval highlights:", "语义检索优先命中的文件：", 3
SOURCE_LABELS = {"full": "full editor document", "excerpt": "editor excerpt", "disk": "disk file", "none": "unknown"}
NO_CONTENT_HINT, GENERIC_POINT = "当前没有读取到文件内容，模型只能基于用户问题做一般性回答。", "当前文件不是 Python 文件，因此只做基础文本级分析。"
UNFINISHED_HINT, LONG_FILE_HINT = "文件中包含 TODO 或 FIXME，说明仍有未完成事项。", "文件行数较多，后续可以考虑拆分模块。"
PLANNED_SUMMARIES = {"create_file": "新增文件：", "update_documentation": "同步更新文档：", "active": "根据当前需求优化活动文件：", "other": "根据项目上下文更新相关文件："}
SHORT_SUMMARIES = {"create_file": "新增文件", "update_documentation": "更新文档", "other": "修改文件"}
OUTCOME_HEADS = {"applied": "已执行文件修改", "skipped": "未执行文件修改", "failed": "文件修改失败"}
OUTCOME_FILE, OUTCOME_NOTE, OUTCOME_REASON = "文件：", "说明：", "原因："
OVERALL_REASONS = {"many": ("涉及 ", " 个文件"), "wide": "覆盖多个目录", "high": "至少一个文件属于高风险改写", "signature": "存在接口或结构定义变化", "none": "本次修改范围较集中"}
OVERALL_SEPARATOR, OVERALL_PARTS = "，", 3
RISK_NAMES = {"low": "低风险", "medium": "中风险", "high": "高风险"}
REPORT_TITLE, REPORT_RULE, REPORT_AVERAGE = "学生成绩报告", "=" * 40, "全班平均分: "
STUDENT_LABELS = ("姓名: ", "数学: ", "英语: ", "Python: ", "平均分: ", "等级: ")
NO_WORKSPACE_PREFIX = "当前没有打开项目文件夹。请先仅针对当前活动文件处理下面这条需求，不要规划多文件方案："
STREAM_STATUS = {"edit": "正在生成实时 patch", "workspace": "正在规划项目级修改", "chat": "正在生成回复"}
MISSING_MODEL_WORDS = ["not found", "manifest"]
DEMO_FILE, DEMO_SUMMARY = "sample_student_manager.py", "演示保底方案：优化示例文件的结构与异常处理"
CUSTOM_PRESET, CUSTOM_LABEL, ESCAPED_BRACKET = "custom-local", "小研", "\\u003c"
APPLY_NOTES = {"failed": "failed", "shown_diffs": 5, "notes": 4, "related": 3}
