"""Rule tables of the rule-driven analysis: routes, risky patterns, controls and their evidence.

Patterns of risky lines and of evidence are valid in Java regex and RE2 alike (no lookaround, no
backreference) and never match across a line break, so that testing a whole file equals testing its lines.
"""

from __future__ import annotations

# Scales and limits of the report format.
HTTP_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
MAX_TRACE_DEPTH = 10
SNIPPET_LINES = 3
CONTROL_CAP = {"critical": 10, "high": 10, "medium": 7, "low": 4}

# Files that may define routes.
ROUTE_FILES = r"(?:route|controller|handler|api|app|server|main|index|urls|views)[^/]*(?:/|$)"

# What a text holds if it may define or mount routes at all.
ROUTE_SIGNS = (
    r"\.\s*(?:route|use|register|get|post|put|patch|delete|options|head|all)\s*[(<]|@[A-Z][a-z]+|path\("
    r"|_rule\(|_router?\(|_blueprint\(|function"
)
_SCRIPT = [".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx"]
# The inside of a call, with strings and one more pair of brackets in it.
_INSIDE = r"""(?:[^()"'`]|"[^"\n]*+"|'[^'\n]*+'|`[^`]*+`|\((?:[^()"']|"[^"\n]*+"|'[^'\n]*+')*+\))*+"""
QUOTED = r"""['"`]([^'"`\n]*)['"`]"""

# Route patterns are searched in code without comments (``operators/code.py``), so they may span lines.
# (name, extensions, pattern, method group, route group); group 0 means "not in the text".
ROUTE_RULES = [
    ("script_router", _SCRIPT,
     r"(?=[arRsf])(?:app|[rR]outer|server|fastify)\s*+\.\s*+(get|post|put|patch|delete|options|head|all)\s*(?:<[^<>()]*>\s*)?\(\s*" + QUOTED, 1, 2),
    ("python_verb", [".py"],
     r"""@[A-Za-z_][\w.]*\.(get|post|put|patch|delete|options|head)\(\s*(?:(?:path|rule)\s*=\s*)?[rfb]?['"]([^'"\n]*)['"]""", 1, 2),
    ("python_path", [".py"], r"""(?<![\w.])(?:re_)?path\(\s*r?['"]([^'"\n]*)['"]\s*,\s*+(?!include\b)""", 0, 1),
]
# Annotations whose arguments name a path, several paths, or methods: (name, extensions, pattern, method group,
# arguments group). Paths stand alone or under one of the keys.
ANNOTATION_RULES = [
    ("decorator", [".ts"], rf"@(Get|Post|Put|Patch|Delete|Options|Head|All)\s*\(({_INSIDE})\)", 1, 2),
    ("mapping", [".java", ".kt"], rf"@(Get|Post|Put|Patch|Delete)Mapping\b(?:\s*\(({_INSIDE})\))?", 1, 2),
    ("request_mapping", [".java", ".kt"], rf"@RequestMapping\s*\(({_INSIDE})\)(?![^;{{}}]*\b(?:class|interface)\b)", 0, 1),
    ("python_route", [".py"], rf"(?:@[A-Za-z_][\w.]*\.(?:api_)?route|\.add_(?:url_rule|api_route))\(({_INSIDE})\)", 0, 1),
]
PATH_ARGUMENT = (
    r"""(?:^\s*|\b(?:value|path|rule)\s*=\s*)"""
    r"""([\[{](?:\s*,?\s*(?:"[^"\n]*"|'[^'\n]*'|`[^`]*`))*+\s*,?\s*[\]}]|[rf]?"[^"\n]*"|[rf]?'[^'\n]*'|`[^`]*`)"""
)
METHOD_ARGUMENT = r"""\bmethods?\s*=\s*([\[({][^\])}]*[\])}]|[\w.]+)"""
# The path that a class puts before the routes of its methods, by rule; a file that calls itself a router may
# have a path of its own too.
CLASS_PREFIX = {
    "decorator": r"""@Controller\s*\(\s*(?:\{[^}]*\bpath\s*:\s*)?['"`]([^'"`\n]*)['"`]""",
    "mapping": rf"""@RequestMapping\s*\(\s*(?:[^()]*\b(?:value|path)\s*=\s*)?\{{?\s*"([^"\n]*)"{_INSIDE}\)(?=[^;{{}}]*\b(?:class|interface)\b)""",
    "python_verb": r"""(?=[AB])(?:APIRouter|Blueprint)\([^()]*?\b(?:url_)?prefix\s*=\s*['"]([^'"\n]*)['"]""",
}
CLASS_PREFIX["request_mapping"] = CLASS_PREFIX["mapping"]
CLASS_PREFIX["python_route"] = CLASS_PREFIX["python_verb"]
# A route handler file names its route by its own directory.
HANDLER_FILE = r"(?:^|/)app/(?:(.*)/)?route\.(?:ts|js)$"
HANDLER_EXPORT = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s*\("

MOUNT_SIGNS = r"(?=[.ri])(?:\.\s*(?:use|register)\s*\(|register_blueprint|include(?:_router)?\()"
# Routers put below a path: (extensions, pattern, prefix group, router group, prefix pattern over the match).
# A router is a name bound by an import, a module named on the spot, or a member of one.
MOUNT_RULES = [
    (_SCRIPT, rf"(?=[arRs])(?:app|[rR]outer|server)\s*+\.\s*+use\(\s*(?:['\"`]([^'\"`\n]*)['\"`]\s*,)?{_INSIDE}\)", 1, r"""([\w$.]+|require\(\s*['"][^'"]*['"]\s*\)(?:\.\w+)?)\s*\)$""", None),
    (_SCRIPT, rf"(?=[afsi])(?:app|fastify|server|instance)\s*+\.\s*+register\({_INSIDE}\)", 0, r"""register\(\s*((?:require|import)\(\s*['"][^'"]*['"]\s*\)(?:\.\w+)?|[\w$.]+)""", r"""prefix\s*:\s*['"`]([^'"`\n]*)['"`]"""),
    ([".py"], rf"\.(?:include_router|register_blueprint)\({_INSIDE}\)", 0, r"(?:include_router|register_blueprint)\(\s*([\w.]+)", r"""\b(?:url_)?prefix\s*=\s*['"]([^'"\n]*)['"]"""),
    ([".py"], r"""(?<![\w.])(?:re_)?path\(\s*r?['"]([^'"\n]*)['"]\s*,\s*include\(\s*['"]?([\w.]+)['"]?""", 1, r"""include\(\s*(['"]?[\w.]+)['"]?$""", None),
]
# Names that imports bind: (pattern, names group, module group).
SCRIPT_BINDING = [
    (r"""import\s+(?:type\s+)?((?:[\w$]+\s*,\s*)?(?:[\w$]+|\*\s*as\s+[\w$]+|\{[^}]*\}))\s*from\s*['"]((?:\.|@/)[^'"\n]*)['"]""", 1, 2),
    (r"""(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*(?:await\s+)?(?:require|import)\(\s*['"]((?:\.|@/)[^'"\n]*)['"]""", 1, 2),
]

# Sensitivity, first match wins; everything else is medium.
SENSITIVITY_RULES = [
    ("critical", r"auth|login|token|password|passwd|payment|billing|secret|credential|session|admin"),
    ("high", r"user|account|profile|upload|webhook|order|customer|external"),
    ("low", r"health|status|ping|public|static|docs|version"),
]

# Relative module names and those below the alias of the source folder.
SCRIPT_IMPORT = r"""(?=[fri])(?:from\s*|require\(\s*|import\(\s*|import\s*)['"]((?:\.|@/)[^'"\n]*)['"]"""
SOURCE_ALIAS = "@/"
SOURCE_FOLDER = "src"
# Names stand on one line, which a backslash may continue, or in brackets on any number of lines.
PYTHON_FROM = (
    r"(?:^|\n)[ \t]*from[ \t]+(\.*)([A-Za-z0-9_.]*)[ \t]+import[ \t]*"
    r"(\([^()]*+\)|(?:[ \t]|\\\n)*+[A-Za-z_](?:[A-Za-z0-9_, \t]++|\\\n)*+)"
)
PYTHON_MODULES = r"(?:^|\n)[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_., \t]*)"
JVM_IMPORT = r"(?:^|\n)[ \t]*import[ \t]+(?:static[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)"
# Folders that a class name does not mention.
JVM_ROOT = r"^(?:.*/)?src/(?:main|test)/(?:java|kotlin)/"

# (type, severity, substrings of which a match has at least one, pattern, title, recommendation)
VULNERABILITY_RULES = [
    ("sql_injection", "critical", ["SELECT", "INSERT", "UPDATE", "DELETE"],
     r"""(?:query|execute|raw)\([^\n]*(?:SELECT|INSERT|UPDATE|DELETE)[^\n]*['"`][ \t]*(?:\+|%|\.format\()""",
     "SQL built from strings", "Use parameterized queries"),
    ("xss", "high", ["innerHTML", "outerHTML", "document.write", "dangerouslySetInnerHTML"],
     r"(?:innerHTML|outerHTML)[ \t]*=|document\.write\(|dangerouslySetInnerHTML",
     "HTML written without encoding", "Encode output or use text nodes"),
    ("command_injection", "critical", ["system(", "exec", "spawn(", "eval(", "subprocess."],
     r"(?:os\.system|subprocess\.[a-z_]+|exec|execSync|spawn|eval)\([^\n]*(?:req\.|request\.|user_input|params)",
     "Command or code from user input", "Pass arguments as a list and validate them"),
    ("path_traversal", "high", ["readFile", "createReadStream", "sendFile", "open("],
     r"(?:readFile|readFileSync|createReadStream|sendFile|open)\([^\n]*(?:req\.|request\.)",
     "File path from user input", "Resolve the path and check that it stays below its root"),
    ("hardcoded_secret", "high", ["key", "Key", "KEY", "ecret", "ECRET", "oken", "OKEN", "assword", "ASSWORD"],
     r"""(?:api_?key|apiKey|API_?KEY|[sS]ecret|SECRET|[tT]oken|TOKEN|[pP]assword|PASSWORD)[ \t]*[:=][ \t]*["'][^"'\n]{16,}["']""",
     "Secret in source code", "Move the secret to a secret store"),
    ("insecure_deserialization", "critical", ["pickle.load", "yaml.load", "unserialize(", "ObjectInputStream"],
     r"pickle\.loads?\(|yaml\.load\(|unserialize\(|ObjectInputStream",
     "Untrusted data deserialized", "Use a data-only format"),
    ("ssrf", "high", ["fetch(", "axios", "requests.", "urlopen("],
     r"(?:fetch|axios(?:\.[a-z]+)?|requests\.[a-z]+|urlopen)\([^\n]*(?:req\.|request\.|user_input)",
     "Request address from user input", "Check the address against an allow list"),
    ("weak_crypto", "medium", ["createHash(", "hashlib.", "MessageDigest"],
     r"""createHash\(['"](?:md5|sha1)|hashlib\.(?:md5|sha1)\(|MessageDigest\.getInstance\("(?:MD5|SHA-?1)""",
     "Weak hash function", "Use SHA-256 or a password hash"),
    ("authentication_bypass", "critical", ["verify", "check"],
     r"(?:verify|check)[A-Za-z_]*[ \t]*[:=][ \t]*(?:false|False)", "Verification switched off", "Verify every credential"),
    ("authorization_flaw", "high", ["isAdmin", "role"],
     r"(?:isAdmin|role)[ \t]*=[ \t]*req\.", "Role taken from the request", "Derive roles on the server"),
    ("sensitive_data_exposure", "medium", ["password", "token", "secret"],
     r"(?:console\.log|logger\.[a-z]+|print)\([^\n]*(?:password|token|secret)",
     "Sensitive value in a log", "Mask sensitive values"),
    ("insecure_configuration", "medium", ["ebug", "DEBUG", "cors(", "ccess-"],
     r"(?:[dD]ebug|DEBUG)[ \t]*=[ \t]*[tT]rue|cors\([ \t]*\)|[aA]ccess-[cC]ontrol-[aA]llow-[oO]rigin[^\n]*\*",
     "Unsafe setting", "Restrict the setting to trusted origins and environments"),
    ("other", "low", ["<script>"], r"<script>[^<\n]", "Inline script", "Load scripts from files under a content policy"),
]

# (id, name, description, category, required, importance, owasp, applies to (pattern over method and route;
#  empty: always), substrings of which one shows the control)
CONTROLS = [
    ("AUTHN-001", "Authenticated access", "Reject requests without a valid session or token", "authentication", True,
     "critical", ["A07:2021"], r"auth|login|user|account|order|payment|upload|admin", ["auth,", "auth)", "auth(", "passport.", "@login_required", "@PreAuthorize"]),
    ("CRYPT-001", "Password hashing", "Store passwords with an adaptive hash", "cryptography", True,
     "critical", ["A02:2021"], r"login|password|register|users", ["bcrypt", "argon2", "pbkdf2", "scrypt"]),
    ("INJ-001", "Parameterized queries", "Bind values instead of building statements", "injection_prevention", True,
     "critical", ["A03:2021"], r":[a-z]+|\{[a-z]+\}|<[a-z:]+>", [".prepare(", "parameterized", "PreparedStatement"]),
    ("AUTHZ-001", "Ownership check", "Check that the caller owns the record", "authorization", True,
     "high", ["A01:2021"], r"^(?:PUT|PATCH|DELETE)|,(?:PUT|PATCH|DELETE)", ["isOwner", "checkOwner", "@PostAuthorize", "owner_id"]),
    ("INPUT-001", "Input validation", "Check type, length and range of every field", "input_validation", True,
     "high", ["A03:2021"], r"POST|PUT|PATCH", ["validate(", "joi.", "zod.", "@Valid"]),
    ("ACCESS-001", "Role check", "Limit administrative routes to roles", "access_control", True,
     "high", ["A01:2021"], r"admin|delete|payment", ["hasRole", "requireRole", "@RolesAllowed"]),
    ("ERR-001", "Safe error replies", "Return no internals in errors", "error_handling", True,
     "medium", ["A05:2021"], r"", ["catch (", "except Exception", "@ExceptionHandler"]),
    ("RATE-001", "Rate limiting", "Limit attempts per client", "rate_limiting", False,
     "high", ["A07:2021"], r"auth|login|payment|upload", ["rateLimit", "limiter", "@Throttle"]),
    ("SESS-001", "Session protection", "Rotate and expire sessions", "session_management", False,
     "high", ["A07:2021"], r"login|session", ["httpOnly", "regenerate("]),
    ("CSRF-001", "Request forgery protection", "Require a token on state changes", "session_management", False,
     "high", ["A01:2021"], r"POST|PUT|PATCH|DELETE", ["csrf", "csurf"]),
    ("DATA-001", "Data protection", "Encrypt personal and payment data at rest", "data_protection", False,
     "high", ["A02:2021"], r"payment|users|account", ["encrypt(", "createCipheriv", "Fernet"]),
    ("OUT-001", "Output encoding", "Encode values before rendering", "output_encoding", False,
     "medium", ["A03:2021"], r"GET", ["escape(", "helmet(", "sanitize"]),
    ("LOG-001", "Audit log", "Record who did what", "logging_monitoring", False,
     "medium", ["A09:2021"], r"", ["logger.", "audit"]),
    ("SIZE-001", "Size limits", "Limit body and file size", "input_validation", False,
     "low", ["A04:2021"], r"upload|POST", ["maxFileSize", "limit:", "MAX_CONTENT_LENGTH"]),
]
CATEGORIES = [
    "authentication", "authorization", "input_validation", "output_encoding", "cryptography", "session_management",
    "error_handling", "logging_monitoring", "rate_limiting", "data_protection", "injection_prevention", "access_control",
]

# What a framework does without any code: (framework, control id, handled by, explanation)
HANDLED = [
    ("django", "INJ-001", "Django ORM", "Queries bind their values"),
    ("django", "CSRF-001", "CSRF middleware", "On by default"),
    ("django", "OUT-001", "Django templates", "Values are escaped by default"),
    ("flask", "OUT-001", "Jinja templates", "Values are escaped by default"),
    ("springboot", "SESS-001", "Spring Security", "Sessions are renewed at login"),
    ("springboot", "ERR-001", "Spring Boot", "Default error replies hide internals"),
    ("nextjs", "OUT-001", "React", "Values are escaped by default"),
    ("express", "ERR-001", "Express", "The default handler hides stacks in production"),
    ("fastify", "INPUT-001", "Fastify", "Route schemas are checked"),
    ("nestjs", "ERR-001", "Nest", "Built-in exception filters hide internals"),
]
