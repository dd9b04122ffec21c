"""Values that results depend on."""

# fixed values
TYPE_KEYWORDS = {
    "sql_injection": ["sql injection", "sqli", "sql inject"],
    "xss": ["xss", "cross-site scripting", "cross site scripting"],
    "command_injection": ["command injection", "rce", "remote code execution"],
    "path_traversal": ["path traversal", "directory traversal"],
    "ssrf": ["ssrf", "server-side request forgery"],
    "xxe": ["xxe", "xml external entity"],
    "csrf": ["csrf", "cross-site request forgery"],
    "deserialization": ["deserialization", "insecure deserialization"],
    "auth_bypass": ["authentication bypass", "auth bypass", "authorization bypass"],
    "code_injection": ["code injection", "eval injection"],
}

# fixed values
EXTENDED_TYPE_KEYWORDS = {
    "sql_injection": ["sql injection", "sqli", "sql inject"],
    "xss": ["xss", "cross-site scripting", "cross site scripting"],
    "command_injection": ["command injection", "rce", "remote code execution", "os command injection"],
    "path_traversal": ["path traversal", "directory traversal", "file traversal"],
    "ssrf": ["ssrf", "server-side request forgery", "server side request forgery"],
    "xxe": ["xxe", "xml external entity"],
    "csrf": ["csrf", "cross-site request forgery", "cross site request forgery"],
    "deserialization": ["deserialization", "insecure deserialization", "unsafe deserialization"],
    "auth_bypass": ["authentication bypass", "auth bypass", "authorization bypass", "access control"],
    "code_injection": ["code injection", "eval injection", "script injection"],
    "buffer_overflow": ["buffer overflow", "stack overflow", "heap overflow"],
    "format_string": ["format string", "string format"],
    "integer_overflow": ["integer overflow", "integer underflow"],
    "use_after_free": ["use after free", "use-after-free"],
}

# fixed values
SECURITY_KEYWORDS = [
    "security", "vulnerability", "CVE", "SQL injection", "XSS", "CSRF", "command injection", "RCE", "path traversal",
    "SSRF", "XXE", "fix security", "authentication bypass", "deserialization", "unsafe", "sanitize", "exploit",
    "malicious", "injection", "buffer overflow", "privilege escalation", "information disclosure",
]

# fixed values
ADVISORY_EXTENSIONS = [".py", ".js", ".ts", ".java", ".rb", ".go", ".php", ".cs", ".cpp", ".c", ".rs", ".jsx", ".tsx"]
CVE_EXTENSIONS = [".py", ".js", ".java", ".c", ".cpp", ".cs", ".rb", ".php", ".go", ".rs", ".swift", ".kt", ".scala", ".ts", ".jsx", ".tsx"]
EXPLOIT_EXTENSIONS = [".py", ".c", ".cpp", ".java", ".js", ".rb", ".php", ".pl", ".sh", ".bat", ".ps1", ".go", ".rs"]
LANGUAGE_FILES = {"python": [".py"], "javascript": [".js", ".ts", ".jsx", ".tsx"]}

# fixed values
EXPLOIT_LANGUAGES = {".py": "Python", ".c": "C", ".cpp": "C++", ".java": "Java", ".js": "JavaScript", ".rb": "Ruby", ".php": "PHP", ".pl": "Perl", ".sh": "Bash", ".bat": "Batch", ".ps1": "PowerShell", ".go": "Go", ".rs": "Rust"}
EXTENSION_LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".c": "c", ".h": "c", ".php": "php", ".rb": "ruby", ".sql": "sql", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala"}
SOURCE_LANGUAGES = {"python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "jsx": "javascript", "node": "javascript", "nodejs": "javascript", "ecmascript": "javascript", "c": "c", "h": "c", "ansic": "c"}
SOURCE_EXTENSIONS = {"py": "python", "pyw": "python", "js": "javascript", "jsx": "javascript", "cjs": "javascript", "c": "c", "h": "c"}
LANGUAGE_HINTS = {"cursor.execute": "python", "os.system": "python", "subprocess": "python", "requests.get": "python", "conn.prepareStatement": "java", "Runtime.getRuntime": "java", "HttpURLConnection": "java", "Paths.get": "java", "fs.readFileSync": "javascript", "fetch(": "javascript", "document.getElementById": "javascript", "shell_exec": "php", "file_get_contents": "php", "escapeshellarg": "php", "$_GET": "php"}

# fixed values
CWE_TYPES = {"CWE-89": "sql_injection", "CWE-79": "xss", "CWE-78": "command_injection", "CWE-77": "command_injection", "CWE-22": "path_traversal", "CWE-918": "ssrf", "CWE-611": "xxe", "CWE-352": "csrf", "CWE-502": "deserialization", "CWE-287": "auth_bypass", "CWE-94": "code_injection", "CWE-95": "code_injection", "CWE-120": "buffer_overflow", "CWE-121": "buffer_overflow", "CWE-122": "buffer_overflow", "CWE-134": "format_string", "CWE-190": "integer_overflow", "CWE-416": "use_after_free"}

# fixed values
RISKY_PATTERNS = [
    r"\bstrcpy\b", r"\bstrcat\b", r"\bsprintf\b", r"\bgets\b", r"\bmemcpy\b", r"\bmemmove\b", r"\bscanf\b",
    r"\bsystem\b", r"\bexec\b", r"\bpopen\b", r"\bshell_exec\b", r"\beval\b", r"\bunserialize\b",
    r"\bexecute\b.*\+", r"\bquery\b.*\+", r'"\s*\+\s*', r"'\s*\+\s*", r"\[\s*\w+\s*\+\s*\w+\s*\]",
]

# fixed values
SQL_CONCAT = r"""["'].*\+.*["']|f["'].*\{.*\}.*["']"""
EXECUTE_CALL = r"\.(execute|query|raw|exec)\s*\("
USER_INPUT = r"(request\.|input\s*\(|GET\[|POST\[|params\[)"
# fixed values: most loops, conditionals, calls, try blocks and string operations that count
SYNTAX_CAPS = (50, 50, 100, 20, 50)
METRIC_SCALES = [100, 100, 5, 5, 5, 10, 10, 20, 5, 10]

# fixed values
PII_PATTERNS = [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"/[Uu]sers/\w+/", r"/home/\w+/"]

# fixed values
WATCHED_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".cpp", ".c", ".h", ".php", ".rb", ".sql", ".cs", ".swift", ".kt", ".scala", ".r", ".m"]
IGNORED_DIRS = ["node_modules", ".git", "__pycache__", "venv", "env", "dist", "build", ".vscode", ".idea", "target", "out", ".gradle", ".npm", "bower_components", "vendor", ".bundle", "tmp", "temp"]
IGNORED_NAMES = [".pyc", ".pyo", ".so", ".dll", ".dylib", ".class", ".jar", ".war", ".min.js", ".map", ".lock", ".log"]

# fixed values
PAIR_RATES = {"cve": 0.25, "github": 0.35, "repo": 0.82, "synthetic": 1.0}
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]
