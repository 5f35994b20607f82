"""Word lists, markers and texts that results must agree on."""

#: Directory words of code that is costly to set up in a test.
HIGH_COST = (
    "cache", "captcha", "cmd", "config", "controller", "controllers", "database", "db", "distlock", "docs", "email",
    "global", "initialize", "middleware", "migration", "migrations", "redis", "router", "routes", "server", "service", "services",
)

#: Path words of code that is cheap to test.
LOW_COST = ("date", "format", "formatter", "helper", "helpers", "math", "parser", "strings", "time", "util", "utils", "validator")

#: File extensions for which script frameworks get tasks.
SCRIPT_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
SCRIPT_FRAMEWORKS = ("javascript", "typescript", "jest", "vitest", "mocha", "node-test", "nyc")

MODULE_MARKERS = (
    "cannot find module", "module not found", "err_module_not_found", "failed to resolve import", "cannot find package",
    "no required module provides package", "is not in std", "cannot use import statement outside a module",
)
PYTHON_IMPORT_MARKERS = ("modulenotfounderror:", "importerror:", "cannot import name", "attempted relative import")
COMPILE_MARKERS = (
    "syntaxerror:", "build failed", "compilation failed", "compile failed", "declared and not used", "imported and not used",
    "not enough arguments in call", "too many arguments in call", "assignment mismatch", "missing return", "expected declaration", "expected ';'",
)
EXTERNAL_RUN_MARKERS = (
    "timeout", "timed out", "deadline exceeded", "context deadline", "signal: killed", "econnrefused", "connection refused",
    "unavailable", "grpc", "too many requests",
)
EXTERNAL_TARGET_MARKERS = (
    "rpcclient", "rpc client", "grpc", "endpoint", "endpoints", "sendmessage", "send message", ".send(", "endtransaction",
    "recoverorphanedtransaction", "route data",
)

#: Confidence of each failure category.
CATEGORY_CONFIDENCE = {
    "module_resolution": 0.8, "python_import_error": 0.8, "compile_error": 0.75, "expectation_mismatch": 0.8, "index_out_of_range": 0.9,
    "divide_by_zero": 0.95, "runtime_panic": 0.9, "undefined_symbol": 0.7, "type_mismatch": 0.7, "generic_failure": 0.5,
}
CATEGORY_FOCUS = {
    "expectation_mismatch": "对比实际值和期望值，判断应修正测试断言还是实现返回路径。",
    "index_out_of_range": "补充边界检查，并用空集合、单元素集合和最大索引验证。",
    "divide_by_zero": "明确除数为 0 时的业务语义，并断言错误返回或 fallback 行为。",
    "runtime_panic": "定位 panic 行的 nil、slice、map、接口或类型断言访问，并补充异常输入测试。",
    "module_resolution": "检查 import/require 路径、package 安装状态、模块类型和测试文件相对路径。",
    "python_import_error": "检查 Python 模块路径、包初始化文件、虚拟环境依赖和测试工作目录。",
    "compile_error": "先修复编译错误，再重新运行同一测试命令。",
    "undefined_symbol": "确认符号拼写、作用域和 import/package 前缀。",
    "type_mismatch": "对齐函数签名、变量声明和调用参数类型。",
    "generic_failure": "先复现失败，再判断问题属于测试期望、实现逻辑还是环境依赖。",
}
GAP_FOCUS = {
    "branch": "断言未覆盖分支的返回值或副作用",
    "error_path": "断言错误、异常或空值路径",
    "return_path": "断言未覆盖返回路径的具体结果",
    "statement": "断言未覆盖语句执行后的可观察结果",
}
#: Score and reason of each kind of gap.
GAP_SCORE = {
    "branch": (30, "分支缺口通常能生成高价值断言"),
    "error_path": (28, "错误或空值路径通常容易补充明确断言"),
    "return_path": (20, "返回路径可直接断言结果"),
    "statement": (10, "普通语句缺口有明确行号"),
}
REASON_FUNCTION, REASON_WHOLE_FILE = "已定位到具体函数或方法", "整文件泛化任务靠后处理"
REASON_INPUTS, REASON_LINES, REASON_TEST_FILE = "已有建议输入", "已有未覆盖行列表", "已有推荐测试文件"
REASON_HIGH_COST = "路径疑似依赖 HTTP、数据库、中间件或外部服务，自动补测成本较高"
REASON_LOW_COST = "路径疑似低依赖工具或纯辅助代码，优先自动补测"

#: Texts of suggestions and tasks.
REASON_BLOCK = "此代码块未被测试覆盖"
REASON_LOW_FILE = "文件覆盖率仅 %.1f%%，建议优先补充测试"
MISSING_IF = "未覆盖 if 分支: "
MISSING_MATCH = "未覆盖 match 分支"
MISSING_SWITCH = "未覆盖 switch/case 分支"
MISSING_ERROR = "未覆盖错误或空值返回路径"
MISSING_RETURN = "未覆盖返回路径"
MISSING_STATEMENT = "未覆盖普通语句块"
SOME_CONDITION = "条件表达式"
HINT_ARGUMENT = "构造覆盖未执行分支的参数"
HINT_SET = "设置 "
HINT_TO_COVER = " 覆盖未执行分支"
GOAL_FOR = "为 "
GOAL_COVER = " 补充测试，覆盖未执行行段 "
FOCUS_LINES = "覆盖未执行行: "
REASON_CONFIDENCE = "置信度 %.2f"

#: Patterns of assertion messages that give the actual and the expected value; the first that fits counts.
ASSERTION_PATTERNS = (
    r"(?i)=\s*(.+?),\s*want\s+(.+)$",
    r"(?i)expected\s+(.+?)\s+to\s+(?:be|equal)\s+(.+?)(?:\s*//.*)?$",
    r"(?i)expected\s+(.+?)\s+to\s+(?:deep\s+)?equal\s+(.+)$",
)
#: Lower-case names of test files: a part, a beginning, endings.
TEST_FILE_PART, TEST_FILE_START, TEST_FILE_ENDS = "_test.", "test_", (".test.js", ".spec.js", ".test.ts", ".spec.ts")
UNKNOWN_FRAMEWORK = "不支持的覆盖率框架: "

#: Texts in previews of generated tests, targets and hints that decide on manual review.
SKIP_TODO = 't.Skip("TODO: fill in meaningful test inputs and expected values")'
SKIP_INIT = 't.Skip("init functions cannot be called directly; review package initialization manually")'
UNREACHABLE_TARGET, UNREACHABLE_HINT = "RemoteIP", "partIndex < 0"
ENVIRONMENT_TARGETS = ("InitDisk", "InitCPU", "InitRAM")
PROTOCOL_TARGETS = ("RunClient", "QueryStatus", "SendControl")
ERROR_HINT = "err != nil"
DATABASE_HINTS = ("err != nil", "Error != nil", "RowsAffected", "gorm")
PRIVATE_RUN_MARKERS = ("Private field", "private field")

HINT_CONDITION, HINT_INPUT = "构造满足条件 `", "` 的输入"
MISSING_SELECT = "未覆盖 select/case 分支"
#: Reasons of located gaps: of Go, of other languages.
REASON_IN_GO, REASON_IN_OTHER = " 中的代码块未被测试覆盖", " 中的代码行未被测试覆盖"

#: Folders under which a reported path may lie.
SOURCE_ROOTS = ("src/main/java", "src/test/java", "src/main/rust", "src", "crates")

#: Advice for each failure category: heading, and the three steps below it.
ADVICE = {
    "expectation_mismatch": ("期望值不匹配", ("1. 如果期望值错误，修正测试断言中的 want/expected 值。", "2. 如果实际值错误，优先检查目标函数的返回路径和边界条件。", "3. 对比失败输入下的实现分支，确认是否漏处理空值、零值、负值或错误返回。")),
    "index_out_of_range": ("数组或切片越界", ("1. 在访问 slice/array 前添加边界检查：idx >= 0 && idx < len(values)。", "2. 如果索引来自输入参数，补充边界输入测试，例如空切片、单元素切片和最大索引。", "3. 如果索引由循环计算得到，检查循环终止条件是否使用了 <= 或错误的长度来源。")),
    "divide_by_zero": ("除零错误", ("1. 在执行除法或取模前添加除零检查，确认除数是否为 0。", "2. 根据业务语义返回错误、默认值或跳过该计算，不要静默吞掉异常输入。", "3. 补充除数为 0 的测试，断言错误返回或约定的 fallback 行为。")),
    "runtime_panic": ("运行时 panic", ("1. 先定位 panic 行访问的指针、map、slice、接口或类型断言。", "2. 对可能为 nil 的值增加显式检查，并返回可断言的错误。", "3. 补充 nil/空集合/缺失字段测试，避免只覆盖正常路径。")),
    "module_resolution": ("模块或依赖解析失败", ("1. 检查 import/require 路径是否相对当前测试文件正确，尤其是生成测试写到临时目录或 tests 目录时。", "2. 确认 package.json、go.mod 或依赖安装状态包含目标模块；缺失依赖时先安装或补充 module requirement。", "3. 对 JS/TS 项目，确认 ESM/CommonJS 类型、文件扩展名和测试 runner 的 alias 配置一致。")),
    "python_import_error": ("Python import 失败", ("1. 确认测试命令的工作目录能把源码包放进 sys.path，必要时从项目根运行 pytest。", "2. 检查模块名、包目录、__init__.py 和相对 import 写法是否匹配。", "3. 如果是第三方依赖缺失，先安装测试环境依赖，再重新运行同一测试。")),
    "compile_error": ("编译或语法错误", ("1. 先修复编译错误，不要继续调整测试断言。", "2. 检查函数签名、参数数量、未使用变量/import、返回值数量和语法结构。", "3. 修复后先运行同一个测试文件，再运行相关包或项目测试。")),
    "undefined_symbol": ("未定义引用", ("1. 检查变量、函数或类型名是否拼写正确。", "2. 确认符号是否在当前 package 中导出或可见。", "3. 如果来自其他包，补充正确 import 或使用包名前缀。")),
    "type_mismatch": ("类型不匹配", ("1. 对比函数签名、变量声明和调用参数的实际类型。", "2. 优先修正 API 使用方式；只有语义明确时才添加类型转换。", "3. 如果是泛型、接口或指针/值接收者问题，确认约束和 nil 处理是否正确。")),
    "generic_failure": ("测试失败: ", ("1. 先定位失败测试的输入、断言和目标函数。", "2. 判断问题属于测试期望错误、实现逻辑错误，还是外部依赖/环境问题。", "3. 修复后重新运行同一测试，再运行相关包测试防止回归。")),
}
ADVICE_STEPS, ADVICE_CAUSES = "建议：", "可能的原因和修复建议："
ADVICE_ERROR, ADVICE_SYMBOL, ADVICE_INDEX, ADVICE_LENGTH = "  错误: ", "  符号: ", "  失败索引: ", "  当前长度: "
ADVICE_GOT, ADVICE_WANT, ADVICE_UNKNOWN = "  实际值: ", "  期望值: ", "unknown"
ADVICE_SOURCE, ADVICE_TEST = "源码附近行：", "测试附近行："
#: Categories whose advice repeats the error; shows a source line; shows a test line.
ADVICE_WITH_ERROR = ("runtime_panic", "module_resolution", "python_import_error", "compile_error", "type_mismatch")
ADVICE_WITH_SOURCE = ("expectation_mismatch", "index_out_of_range", "divide_by_zero", "runtime_panic", "compile_error", "type_mismatch", "generic_failure")
ADVICE_WITH_TEST = ("expectation_mismatch", "compile_error", "generic_failure")

#: What shows that generated tests of a kind of file need a look.
REVIEW_MARKS = {
    ".go": (SKIP_TODO,), ".js": (".skip(", "manual_review_"), ".py": ("pytest.skip(", "__import__('pytest').skip(", "manual_review_"),
    ".java": ("Assumptions.assumeTrue(false", "manual_review_"),
}
#: Patterns that code of a language holds if it looks like tests.
TEST_CODE = {
    "go": r"(?m)^\s*func\s+Test[A-Za-z0-9_]*\s*\(",
    "javascript": r"(?m)(?:^|[^\w$])(?:describe|it|test)(?:\s*\(|\.(?:each|only|skip|todo|concurrent)\s*\()|(?:^|[^\w$])expect\s*\(",
    "python": r"(?m)^\s*(?:async\s+)?def\s+test_[A-Za-z0-9_]*\s*\(",
    "rust": r"(?m)#\[(?:[A-Za-z0-9_]+::)?test\]|\bfn\s+test_[A-Za-z0-9_]*\s*\(",
    "java": r"(?m)^\s*@(?:org\.junit\.jupiter\.api\.)?Test\b|\borg\.junit(?:\.jupiter)?\.api\.Test\b",
}
#: What to do about each kind of provider error.
PROVIDER_ACTIONS = {
    "llm_config_missing": "configure_provider", "llm_command_failed": "fix_provider_command_or_retry",
    "llm_empty_output": "retry_model_or_fallback_static", "llm_json_error": "retry_model_or_fallback_static", "llm_missing_code": "retry_model_or_fallback_static",
    "llm_output_cleaning_failed": "retry_model_or_fallback_static", "llm_output_validation_failed": "adjust_prompt_or_fallback_static",
}
PROVIDER_OTHER = "inspect_provider"
#: Words that hint at a database, and at an error.
DATABASE_WORDS = ("sqlalchemy", "db.commit", "db.rollback", "db.query", "sessionlocal", "database", "数据库", "事务")
ERROR_WORDS = ("error", "exception", "err != nil", "失败", "抛出", "rollback", "回滚")
COMMENT_BYTES = 400

# Fixed values of summary and decision documents.
EXPECTED_DECISIONS = ("accept", "accept", "accept", "manual-review", "manual-review", "manual-review", "apply-repair", "needs-better-input")
CONSUMER_REQUIRED = ("helper_ref", "workflow_path", "client_summary_json", "client_summary_validator_json", "client_response_json", "client_response_validator_json", "result_json")
CONSUMER_EXIT_CODES = ("install_summary_validator_exit_code", "client_summary_validator_exit_code", "client_response_validator_exit_code", "fixture_validator_exit_code", "npm_validator_exit_code")
ENTRY_VOCABULARIES = {
    "kind": ("validate_coverage_task", "real_project_agent_loop"),
    "source": ("synthetic", "real_project"),
    "status": ("passed", "failed"),
    "action": ("ready", "manual_review_internal", "manual_review_environment", "manual_review_external_service", "apply_fix_suggestions", "needs_better_input"),
    "expected_decision": ("accept", "manual-review", "apply-repair", "needs-better-input"),
}
REASON_KEYS = ("next_action_reason", "manual_review_reason", "needs_better_input_reason", "coverage_miss_reason", "external_service_reason", "environment_reason", "internal_reason")
#: Kind of document to ((words of a failure, step), ..) in order, and the step of any other failure.
NEXT_STEPS = {
    "client": (
        ((("validator_exit_code",), "inspect-client-validator"), (("fixture_count", "decisions", "client fixture failure"), "inspect-agent-decision-fixtures")),
        "inspect-agent-decision-client-summary",
    ),
    "consumer": (
        ((("fixture_count", "decisions"), "inspect-agent-decision-fixtures"), (("validator_exit_code",), "inspect-consumer-smoke-validator")),
        "inspect-consumer-smoke-summary",
    ),
    "release": (
        (
            (("installer_url", "helper_refs"), "inspect-release-installer"),
            (("agent_next_steps.client",), "inspect-release-client-response"),
            (("agent_next_steps.consumer",), "inspect-release-consumer-response"),
            (("fixture_count", "decisions"), "inspect-agent-decision-fixtures"),
        ),
        "inspect-release-smoke-summary",
    ),
}

# Reasons of validation metadata. {target} is the task's trimmed target, or what stands for an empty one.
REASON_UNREACHABLE = "{target} appears unreachable through the generated public test path; review the coverage report or source branch manually"
REASON_INIT = "Go init functions cannot be called directly from tests; review package initialization side effects manually"
REASON_REMOTE_IP = 'branch "partIndex < 0" appears unreachable because partIndex is derived from a non-empty X-Forwarded-For parts slice'
REASON_ENVIRONMENT = "{target} depends on OS/runtime environment state; use injection or an integration environment instead of treating the generated skip as directly ready"
REASON_ENVIRONMENT_OF = {
    "InitDisk": 'InitDisk error branch depends on disk.Usage("/") returning an OS/runtime error; static tests cannot force it without dependency injection',
    "InitCPU": "InitCPU error branch depends on gopsutil cpu.Counts or cpu.Percent returning an OS/runtime error; static tests cannot force it without dependency injection",
    "InitRAM": "InitRAM error branch depends on mem.VirtualMemory returning an OS/runtime error; static tests cannot force it without dependency injection",
}
REASON_PROTOCOL = "{target} protocol error branch depends on socket write or streaming I/O failure; generate a deterministic fake connection or review manually instead of relying on connection timing"
REASON_DATABASE = "{target} depends on database transaction/session behavior; use a deterministic test database, injected repository/session, or integration fixture instead of treating the generated skip as directly ready"
REASON_REPOSITORY = "{target} database branch depends on GORM DB behavior; generate a deterministic test database or inject a fake repository/DB instead of adding third-party test dependencies implicitly"
REASON_EXTERNAL = "{target} depends on a live RPC/external service, route state, or long retry timing; validate it with injected fake clients/route data or an integration environment instead of treating the generated unit test as directly repairable"
REASON_PRIVATE = "{target} is a JavaScript private method; cover it through a public entry point or review manually instead of calling it directly"
REASON_PRIVATE_FAILED = "{target} is a JavaScript private method; generate a public-entry test or review manually instead of calling it directly"
REASON_INTERNAL_JAVA = "{target} is private/internal Java code; cover it through a visible public or package entry point, add a test seam, or review manually"
REASON_INTERNAL_PYTHON = "{target} is private/internal Python code; cover it through a public method, add a test seam, or review manually"
REASON_INTERNAL_SCRIPT = "{target} is not exported from this JavaScript module; cover it through an exported API, add a test seam, or review manually"
REASON_NO_RUNTIME = "{target} has no runtime JavaScript statements to execute; cover behavior through runtime consumers or type-checking instead of generating a unit test for the type-only module"
REASON_MISSED = "{target} did not cover target line range {range}; generate stronger inputs or cover the target through a better public entry point"
HIT_FRAMEWORKS = ("go-test", "cargo-test", "jest", "vitest", "mocha", "node-test", "pytest", "junit")
#: Each override with its keys of metadata: what is set, and why.
REVIEW_KEYS = {
    "unreachable": ("unreachable", "unreachable_reason"),
    "environment": ("environment_dependent", "environment_reason"),
    "protocol": ("protocol_dependent", "protocol_reason"),
    "database": ("database_dependent", "database_reason"),
    "external_service": ("external_service_dependent", "external_service_reason"),
    "private": ("private_method", "private_reason"),
    "internal": ("internal_symbol", "internal_reason"),
    "no_runtime": ("no_runtime", "no_runtime_reason"),
}

# Patterns of import, export and type lines.
NAMED_IMPORT = r"(?m)import\s+(?:type\s+)?\{([^}]*)\}\s+from\s+['\"]([^'\"]+)['\"]"
EXPORT_FROM = r"(?m)export\s+(?:type\s+)?\{([^}]*)\}\s+from\s+['\"]([^'\"]+)['\"]"
EXPORT_ALL = r"(?m)export\s+(?:type\s+)?\*\s+from\s+['\"]([^'\"]+)['\"]"
EXPORT_LIST = r"(?m)export\s+(?:type\s+)?\{([^}]*)\}\s*(?:;|$)"
EXPORTED_TYPE = r"(?m)export\s+(?:abstract\s+)?(?:class|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)[\s<={]"
SCRIPT_IMPORT_LINE = r"(?md)^\s*import\s+[^;\n]+;?"
SCRIPT_REQUIRE_LINE = r"(?md)^\s*(?:const|let|var)\s+[^=\n]+\s*=\s*require\([^)]+\)\s*;?"
SCRIPT_TYPE_LINE = r"(?md)^\s*(?:export\s+)?(?:class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
PYTHON_IMPORT_LINE = r"(?md)^\s*(?:from\s+\S+\s+import\s+.+|import\s+.+)$"
PYTHON_TYPE_LINE = r"(?md)^\s*class\s+([A-Za-z_]\w*)"
#: Languages by the end of a path.
LANGUAGES = {".go": "go", ".rs": "rust", ".java": "java", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}

# What documents must hold, field by field: "text" is a text that isn't empty, "any" anything, "none" an
# empty list, "decisions" the decisions below, "in:" a text that holds what follows, "below:f/p" path p below field f; others are the value itself as JSON.
DECISIONS = ("accept", "accept", "accept", "manual-review", "manual-review", "manual-review", "apply-repair", "needs-better-input")
DOCUMENTS = {
    "client-adopter-summary": {
        "schema_version": "1", "status": '"passed"', "repo_dir": "text", "readme_path": "text", "package_dir": "text", "result_json": "text", "response_json": "text", "response_validation_json": "text", "consumer_json": "text",
        "fixture_count": "8", "agent_next_step": '"ready"', "should_accept": "true", "npm_exit_code": "0", "failures": "none",
    },
    "client-ci-install-summary": {
        "schema_version": "1", "status": '"passed"', "installer_path": "text", "installer_url": "in:/scripts/install-agent-decision-client-ci-template.sh", "client_dir": "text", "workflow_path": "text", "helper_dir": "text", "helper_ref": "text",
        "summary_json": "text", "response_json": "text", "response_validation_json": "text", "fixture_count": "8", "decisions": "decisions", "failures": "none", "contract_exit_code": "0", "validator_exit_code": "0", "response_validator_exit_code": "0",
    },
    "client-ci-summary": {
        "schema_version": "1", "status": '"passed"', "client_dir": "text", "fixture_dir": "text", "result_json": "text below:client_dir/agent-decision-fixtures-result.json", "result_schema": "text below:fixture_dir/docs/fixtures/agent-decision-fixtures-result.schema.json",
        "fixture_count": "8", "decisions": "decisions", "failures": "none", "validator_exit_code": "0",
    },
    "client-ci-response": {
        "schema_version": "1", "status": '"passed"', "agent_next_step": '"ready"', "summary_json": "text", "evidence": "any", "failures": "none", "evidence.client_dir": "text", "evidence.fixture_dir": "text", "evidence.result_json": "text",
        "evidence.result_schema": "text", "evidence.fixture_count": "8", "evidence.decisions": "decisions", "evidence.validator_exit_code": "0",
    },
    "client-consumer-response": {
        "schema_version": "1", "status": '"passed"', "agent_next_step": '"ready"', "summary_json": "text", "evidence": "any", "failures": "none", "evidence.helper_ref": '"v0.5.21"', "evidence.fixture_count": "8", "evidence.decisions": "decisions",
        "evidence.result_json": "text", "evidence.client_summary_json": "text", "evidence.client_summary_validator_json": "text", "evidence.client_response_json": "text", "evidence.client_response_validator_json": "text", "evidence.workflow_path": "text",
        "evidence.install_summary_validator_exit_code": "0", "evidence.client_summary_validator_exit_code": "0", "evidence.client_response_validator_exit_code": "0", "evidence.fixture_validator_exit_code": "0", "evidence.npm_validator_exit_code": "0",
    },
    "client-consumer-smoke-summary": {
        "schema_version": "1", "status": '"passed"', "client_dir": "text", "workflow_path": "text", "helper_ref": '"v0.5.21"', "install_summary_json": "text", "install_summary_validator_json": "text", "client_summary_json": "text",
        "client_summary_validator_json": "text", "client_response_json": "text", "client_response_validator_json": "text", "fixture_dir": "text", "fixture_validation_json": "text", "result_json": "text", "agent_response_json": "text", "fixture_count": "8",
        "decisions": "decisions", "failures": "none", "install_summary_validator_exit_code": "0", "client_summary_validator_exit_code": "0", "client_response_validator_exit_code": "0", "fixture_validator_exit_code": "0", "npm_validator_exit_code": "0",
    },
    "release-response-install-summary": {
        "schema_version": "1", "status": '"written"', "client_dir": "text", "workflow_path": "text", "package_dir": "text", "release_summary_json": "text", "agent_response_json": "text", "release_ref": "text", "fixture_count": "8",
        "decisions": "decisions", "agent_next_step": '"ready"', "npm_exit_code": "0", "failures": "none",
    },
    "release-response-adopter-summary": {
        "schema_version": "1", "status": '"passed"', "repo_dir": "text", "artifact_dir": "text", "readme_path": "text", "workflow_path": "text", "package_dir": "text", "install_summary_json": "text", "agent_response_json": "text", "consumer_json": "text",
        "summary_consumer_json": "text", "release_ref": 'text "v0.5.21"', "fixture_count": "8", "agent_next_step": '"ready"', "should_accept": "true", "npm_exit_code": "0", "failures": "none",
    },
}
