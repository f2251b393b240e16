"""Rules, tampers, lookups and schemas, as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values: match modes and labels
FUNCTION = "function-param-regex"
CUSTOM = "vustomize-match"
REGEX = "only-regex"
NAMES = "regex-return-regex"
MANIFEST = "special-crx-keyword-match"
PATH = "file-path-regex-match"
VENDOR = "vendor_source_match"
MODES = (FUNCTION, CUSTOM, REGEX, NAMES, MANIFEST, PATH, VENDOR)

LEVELS = ("low", "low", "low", "low", "medium", "medium", "medium", "medium", "high", "high", "critical")
VENDOR_LEVELS = ("None", "low", "low", "low", "medium", "medium", "medium", "medium", "high", "high", "high")
VENDOR_SVID = 9999

# ---------------------------------------------------------------- fixed values: extensions of the scanned languages
EXTENSIONS = {
    "php": (".php", ".php3", ".php4", ".php5", ".php7", ".pht", ".phs", ".phtml"),
    "solidity": (".sol",),
    "javascript": (".js",),
    "chromeext": (".crx",),
    "html": (".html",),
    "base": ("*",),
}

# ---------------------------------------------------------------- fixed values: languages by extension, in order; True: chiefly
LANGUAGES = (
    ("PHP", True, (".php", ".php3", ".php4", ".php5", ".pht", ".phs", ".phtml")),
    ("Java", True, (".java",)),
    ("Python", True, (".py",)),
    ("Solidity", True, (".sol",)),
    ("Javascript", True, (".js",)),
    ("ChromeExt", True, (".crx",)),
    ("JSP", False, (".jsp",)),
    ("C", False, (".h", ".c")),
    ("Ruby", False, (".rb",)),
    ("Perl", False, (".pl",)),
    ("Lua", False, (".lua",)),
    ("Go", False, (".go",)),
    ("Swift", False, (".swift",)),
    ("C++", False, (".c", ".cpp")),
    ("C#", False, (".cs",)),
    ("Header", False, (".h",)),
    ("Objective-C", False, (".m",)),
    ("Scale", False, (".sbt", ".scale")),
    ("Ceylon", False, (".ceylon",)),
    ("Kotlin", False, (".kt",)),
    ("Shell", False, (".sh",)),
    ("Bat", False, (".bat",)),
    ("HTML", True, (".html", ".htm", ".phtml")),
    ("CSS", False, (".css", ".less", ".scss", ".styl")),
    ("Image", False, (".jpg", ".png", ".bmp", ".gif", ".ico", ".cur")),
    ("Font", False, (".eot", ".otf", ".svg", ".ttf", ".woff")),
    ("Conf", False, (".properties", ".conf", ".ini", ".cfg", ".yml", ".xml", ".iml", ".spf", ".manifest")),
    ("CMake", False, (".cmake", ".cmake.in")),
    ("SQL", False, (".sql",)),
    ("Compression", False, (".zip", ".tar", ".tar.gz", ".rar")),
    ("Executable", False, (".exe",)),
    ("Log", False, (".log",)),
    ("Text", False, (".txt", ".text", ".md", ".rst", ".csv")),
    ("Office", False, (".doc", ".docx", ".wps", ".rtf", ".xls", ".ppt")),
    ("Media", False, (".mp3", ".mp4", ".swf", ".flv")),
    ("Certificate", False, (".p12", ".crt", ".key", ".pfx", ".csr")),
    ("Source", False, (".psd", ".ai", ".axure", ".xmind", ".plan")),
    ("Thumb", False, (".db", ".DS_Store")),
    ("Git", False, (".pack", ".idx", ".sample")),
)

# ---------------------------------------------------------------- fixed values: frameworks and their markers, in order
FRAMEWORKS = (
    ("WordPress", "php", ("file", "wp-cron.php"), ("file", "wp-load.php"), ("folder", "wp-admin")),
    ("Joomla", "php", ("file", "images/joomla_black.png"), ("folder", "layout/joomla")),
    ("Drupal", "php", ("file", "core/lib/Drupal.php"), ("file", "core/scripts/drupal.sh"), ("folder", "core/lib/Drupal"), ("folder", "core/tests/Drupal")),
    ("CodeIgniter", "php", ("file", "system/core/CodeIgniter.php"), ("file", "test/codeigniter/Setup_test.php"), ("file", "mocks/ci_testcase.php"), ("folder", "user_guide_src"), ("folder", "tests/codeigniter")),
    ("ThinkPHP", "php", ("file", "ThinkPHP/ThinkPHP.php"), ("folder", "ThinkPHP")),
    ("Laravel", "php", ("file", "app/Http/Kernel.php"), ("file", "app/Console/Kernel.php"), ("file", "config/broadcasting.php"), ("folder", "database/migrations"), ("folder", "storage/framework/testing")),
    ("Kohana", "php", ("file", "system/classes/Kohana.php"), ("file", "modules/auth/config/auth.php"), ("file", "modules/cache/config/cache.php"), ("folder", "modules/userguide"), ("folder", "system/guide/kohanna")),
    ("Yii", "php", ("file", "framework/BaseYii.php"), ("file", "tests/framework/BaseYiiTest.php"), ("folder", "contrib/completion/bash"), ("folder", "framework/web/migrations")),
    ("Symfony", "php", ("file", "PropertyInfo/Type.php"), ("file", "FrameworkBundle/Client.php"), ("folder", "WebServerBundle/Command"), ("folder", "BrowserKit/Tests"), ("folder", "Config/DependencyInjection")),
    ("Phalcon", "php", ("file", "tests/_ci/phaIcon.ini"), ("file", "phaIcon/di.zep"), ("folder", "tests/_data/di"), ("folder", "phaIcon/mvc/collection")),
    ("Slim", "php", ("file", "Exception/SlimException.php"), ("file", "MiddlewareAwareTrait.php"), ("folder", "Handlers/Strategies")),
    ("CakePHP", "php", ("file", "Core/StaticConfigTrait.php"), ("file", "Routing/RequestActionTrait.php"), ("folder", "Core/Configure/Engine"), ("folder", "Database/Dialect")),
    ("Django", "python", ("dependency", "django")),
    ("Flask", "python", ("dependency", "Flask")),
    ("Spring", "java", ("dependency", "org.springframework")),
)

# ---------------------------------------------------------------- fixed values: sanitisers (function: rule ids) and inputs, by tamper
TAMPERS = {
    "default": ({
        "urlencode": (1000, 10001, 10002), "rawurlencode": (1000, 10001, 10002), "htmlspecialchars": (1000, 10001, 10002), "htmlentities": (1000, 10001, 10002),
        "md5": (1000, 10001, 10002), "ldap_escape": (1010,), "mysql_real_escape_string": (1004, 1005, 1006), "addslashes": (1004, 1005, 1006),
        "intval": (1000, 10001, 10002, 1004, 1005, 1006), "escapeshellcmd": (1009, 1011), "escapeshellarg": (1009, 1011),
    }, ("$_GET",)),
    "wordpress": ({
        "esc_url": (1000, 10001, 10002), "esc_js": (1000, 10001, 10002), "esc_html": (1000, 10001, 10002), "esc_attr": (1000, 10001, 10002),
        "esc_textarea": (1000, 10001, 10002), "tag_escape": (1000, 10001, 10002), "esc_sql": (1004, 1005, 1006), "_real_escape": (1004, 1005, 1006),
    }, ()),
    "roundcube": ({"show": (1000, 10001, 10002), "Q": (1000, 10001, 1009, 10002), "login": (1000, 10001, 10002)}, ("get_input_value", "rcube_utils::get_input_value", "getprop")),
    "thinkphp": ({}, ("Input", "request", "I", "input")),
    "phpbb": ({}, ("$request",)),
}

# ---------------------------------------------------------------- fixed values: taint sources
PHP_SOURCES = ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "$HTTP_POST_FILES", "$HTTP_COOKIE_VARS", "$HTTP_REQUEST_VARS", "$HTTP_POST_VARS", "$HTTP_RAW_POST_DATA", "$HTTP_GET_VARS")
JS_SOURCES = (
    "location.hash", "document.cookie", "location.search", "location.href", "window.name",
    "chrome.tabs.query", "chrome.tabs.get", "chrome.tabs.getCurrent", "chrome.tabs.getSelected", "chrome.tabs.getAllInWindow",
    "chrome.runtime.onMessage.addListener", "chrome.runtime.onConnect.addListener", "chrome.runtime.onMessageExternal.addListener", "chrome.runtime.onConnectExternal.addListener",
    "chrome.cookies.get", "chrome.cookies.getAll", ".addEventListener",
)
JS_EVAL = ("eval", "setTimeout")

# ---------------------------------------------------------------- fixed values: manifests, ecosystems
MANIFEST_FILES = {"java": ("pom.xml", "build.gradle"), "golang": ("go.mod",), "python": ("requirements.txt",), "php": ("composer.json",), "nodejs": ("package.json",)}
ECOSYSTEMS = {
    "java": {"osv": "Maven", "depsdev": "maven", "murphysec": "java"},
    "golang": {"osv": "Go", "depsdev": "go", "murphysec": "golang"},
    "python": {"osv": "PyPI", "ossindex": "pypi", "murphysec": "python"},
    "php": {"osv": "Packagist", "ossindex": "composer", "murphysec": "php"},
    "nodejs": {"osv": "npm", "depsdev": "npm", "murphysec": "js"},
}

# ---------------------------------------------------------------- fixed values: the rules
# svid, language, name, level, status, mode, match, then what the mode needs.
_RULES = (
    dict(svid=1000, language="php", rule_name="Reflected XSS", level=4, match_mode=FUNCTION, match=["print|print_r|exit|die|printf|vprintf|trigger_error|user_error|odbc_result_all|ovrimos_result_all|ifx_htmltbl_result"]),
    dict(svid=10001, language="php", rule_name="Reflected XSS", level=4, status=False, match_mode=CUSTOM, match=[r"(echo\s?['\"]?(.+?)?\$(.+?)?['\"]?(.+?)?;)"], extractor="echo"),
    dict(svid=10002, language="php", rule_name="Reflected XSS", level=4, match_mode=FUNCTION, match=["echo|print"], keyword="is_echo_statement"),
    dict(svid=1001, language="php", rule_name="SSRF", level=7, match_mode=CUSTOM, match=[r"curl_setopt\s*\(.*,\s*CURLOPT_URL\s*,(.*)\)"], vul_function="curl_setopt", extractor="curl"),
    dict(svid=1002, language="php", rule_name="SSRF", level=7, match_mode=FUNCTION, match=["file_get_contents"]),
    dict(svid=1003, language="php", rule_name="SSRF", level=7, status=False, match_mode=FUNCTION, match=["get_headers"]),
    dict(svid=1004, language="php", rule_name="SQLI", level=9, match_mode=CUSTOM, match=[r"([\"']+\s*(select|SELECT|insert|INSERT|update|UPDATE)\s+([^;]\s*)(.*)\$(.+?)['\"]+(.+?)?;?)"], extractor="sql"),
    dict(svid=1005, language="php", rule_name="SQLI", level=9, match_mode=FUNCTION, match=["(mysql_query|mysql_db_query)"]),
    dict(svid=1006, language="php", rule_name="SQLI", level=9, match_mode=FUNCTION, match=[r"(mysqli_query|pg_execute|pg_insert|pg_query|pg_select|pg_update|sqlite_query|msql_query|mssql_query|odbc_exec|fbsql_query|sybase_query|ibase_query|dbx_query|ingres_query|ifx_query|oci_parse|sqlsrv_query|maxdb_query|db2_exec)\s?\(]"]),
    dict(svid=1007, language="php", rule_name="RFI", level=8, match_mode=FUNCTION, match=["include|include_once|require|require_once|parsekit_compile_file|php_check_syntax|runkit_import|virtual"]),
    dict(svid=1008, language="php", rule_name="Xml injection", level=7, match_mode=FUNCTION, match=["simplexml_load_file|simplexml_load_string"]),
    dict(svid=1009, language="php", rule_name="RCE", level=10, match_mode=FUNCTION, match=["(array_map|create_function|call_user_func|call_user_func_array|assert|eval|dl|register_tick_function|register_shutdown_function)"]),
    dict(svid=1010, language="php", rule_name="LDAPI", level=3, match_mode=FUNCTION, match=["(ldap_add|ldap_delete|ldap_list|ldap_read|ldap_search|ldap_bind)"]),
    dict(svid=1011, language="php", rule_name="RCE", level=10, match_mode=FUNCTION, match=["(system|passthru|exec|pcntl_exec|shell_exec|popen|proc_open|ob_start|expect_popen|mb_send_mail|w32api_register_function|w32api_invoke_function|ssh2_exec)"]),
    dict(svid=1012, language="php", rule_name="Information Disclosure", level=2, match_mode=FUNCTION, match=["(print_r|var_dump|show_source|highlight_file)"]),
    dict(svid=1013, language="php", rule_name="URL Redirector Abuse", level=1, match_mode=FUNCTION, match=["header"]),
    dict(svid=1014, language="php", rule_name="variable shadowing", level=8, match_mode=FUNCTION, match=["import_request_variables|parse_str|mb_parse_str|extract"]),
    dict(svid=1015, language="php", rule_name="unserialize vulerablity", level=7, match_mode=FUNCTION, match=["is_a|unserialize"]),
    dict(svid=3001, language="javascript", rule_name="JQuery prototype pollution", level=5, status=False, match_mode=REGEX, match=[r"\.extend\(\s*true\s*,"], unmatch=[r"\bjQuery\.extend\s*=\s*jQuery\.fn\.extend\b"]),
    dict(svid=3002, language="javascript", rule_name="XSS", level=5, match_mode=FUNCTION, match=["document.write|document.writeln"]),
    dict(svid=3003, language="javascript", rule_name="RCE", level=10, match_mode=FUNCTION, match=["eval|setTimeout"]),
    dict(svid=3004, language="javascript", rule_name="URL Redirect", level=3, match_mode=FUNCTION, match=["document.location.replace|window.location.replace"]),
    dict(svid=3005, language="javascript", rule_name="HTML injection", level=4, match_mode=CUSTOM, match=[r"(\.innerHTML\s*=\s*([^;]+)\b)"], vul_function="innerHTML", extractor="html"),
    dict(svid=30051, language="javascript", rule_name="HTML injection", level=4, match_mode=CUSTOM, match=[r"(\.outerHTML\s*=\s*([^;]+)\b)"], vul_function="outerHTML", extractor="html"),
    dict(svid=3006, language="javascript", rule_name="HTML attr injection", level=4, match_mode=CUSTOM, match=[r"(\.setAttribute\(\s*[^,]+,([\w_.]*)\s*\))"], vul_function="setAttribute", extractor="attr"),
    dict(svid=30061, language="javascript", rule_name="JQuery HTML attr injection", level=4, match_mode=CUSTOM, match=[r"(\.attr\(\s*[^,]+,([\w_.]*)\s*\))"], vul_function="attr", extractor="attr"),
    dict(svid=3007, language="javascript", rule_name="JQuery XSS", level=4, match_mode=FUNCTION, match=["html|before|insertBefore|insertAfter|after|append|prepend|wrap|wrapAll|wrapInner|appendTo|prependTo"]),
    dict(svid=3008, language="javascript", rule_name="Chrome ext function XSS", level=4, match_mode=FUNCTION, match=["chrome.tabs.update|chrome.tabs.executeScript"]),
    dict(svid=3009, language="javascript", rule_name="JQuery eval?", level=10, match_mode=FUNCTION, match=["globalEval"]),
    dict(svid=3010, language="javascript", rule_name="Handlebars XSS", level=4, match_mode=FUNCTION, match=["SafeString"]),
    dict(svid=3011, language="javascript", rule_name="concatenated argument of executeScript", level=8, match_mode=REGEX, match=["(chrome\\.tabs\\.executeScript\\([^,]+,\\s*{[^}]*('|\")?(code|file)('|\")?\\s*:\\s*((`[^`]*\\${[^`]*`)|(\"[^\"]*\"\\s*\\+)|('[^']*'\\s*\\+)|\\w+))"], unmatch=[r"JSON\.stringify\("], vul_function="executeScript"),
    dict(svid=30111, language="javascript", rule_name="controllable message listener", level=7, match_mode=REGEX, match=["(addEventListener\\(\\s*['\"]{1}message['\"]{1}\\s*,\\s*function\\([^\\)]+\\))"], vul_function="addEventListener"),
    dict(svid=2001, language="solidity", rule_name="fake deposit", level=3, match_mode=REGEX, match=[r"\bif\s*\(.+(?=\))\)\s*\{[^\}]+\}\s*else\s*\{[\s]+return\s+false;"]),
    dict(svid=2100, language="solidity", rule_name="address(0)", level=3, match_mode=NAMES, match=[], match_name=r"(\bfunction\s+[^\n]*?\(.*?address\s+([^, )]*)[^\n\r]*)", black_list=["balanceOf", ";", "[]"], unmatch=[r"\b(if|require)\s*\(=padding=\s!=\s(address\(0\)|0x0)\)"]),
    dict(svid=4001, language="chromeext", rule_name="manifest all_frames", level=3, match_mode=MANIFEST, match=["true"], keyword="content_scripts.*.all_frames"),
    dict(svid=4002, language="chromeext", rule_name="manifest CSP configuration", level=3, match_mode=MANIFEST, match=["'unsafe-inline'", "'unsafe-eval'", "*", None], keyword="content-security-policy"),
    dict(svid=4003, language="chromeext", rule_name="manifest CSP bypass", level=3, match_mode=MANIFEST, keyword="content-security-policy",
         match=[r"ajax\.googleapis\.com", r"raw\.githubusercontent\.com", r"github\.io", r"\*\.s3\.amazonaws\.com", r"\*\.cloudfront\.com", r"\*\.herokuapp\.com", r"dl\.dropboxusercontent\.com", r"\*\.appspot\.com", r"\*\.googleusercontent\.com", r"cdn\.jsdelivr\.net", r"cdnjs\.cloudflare\.com", r"code\.angularjs\.org", r"d\.yimg\.com", r"www\.linkedin\.com", r"\*\.wikipedia\.org"]),
    dict(svid=4004, language="chromeext", rule_name="manifest permissions", level=3, match_mode=MANIFEST, keyword="permissions",
         match=["bookmarks", "history", "topSites", "tabs", "webNavigation", "contentSettings", "debugger", "pageCapture", "proxy", "devtools_page", r"http://\*/\*", r"https://\*/\*", r"\*://\*/\*", "<all_urls>", r"http://\*/", r"https://\*/", "management", "mdns", "geolocation", "clipboardRead", "privacy", "signedInDevices", "ttsEngine"]),
    dict(svid=4104, language="chromeext", rule_name="manifest permissions", level=3, match_mode=MANIFEST, match=["bookmarks", "history", "topSites", "tabs", "pageCapture", "webRequest", "downloads", "sessions"], keyword="permissions"),
    dict(svid=5001, language="base", rule_name="hard-coded password", level=2, match_mode=REGEX, match=["((password)\\b['\"]?\\s*[:=(,]+\\s*['\"]?([^'\"\\s]{3,})['\"]?\\b)"], unmatch=["value", "database", "Keys", "pwd", "null", "str"]),
    dict(svid=5002, language="base", rule_name="hard-coded IP", level=2, match_mode=REGEX, match=["((\\b|'|\"|\\/)[0-9]{1,3}\\.[0-9]{0,3}\\.[0-9]{0,3}\\.[0-9]{0,3}\\s*:[0-9]{2,5})"], unmatch=["127.0.0.1", "172.1", "0.0.0.0", "222.222"]),
    dict(svid=5003, language="base", rule_name="configuration file leak", level=4, match_mode=PATH, match=["settings.py", "config.yaml", "config.php"]),
    dict(svid=5004, language="base", rule_name="git/svn leak", level=2, match_mode=PATH, match=[".git/config"]),
    dict(svid=5005, language="base", rule_name="password file leak", level=7, match_mode=PATH, match=["pass.txt", "password.txt"]),
)

RULE_SCHEMA = T.StructType([
    T.StructField("svid", T.IntegerType(), False), T.StructField("language", T.StringType()), T.StructField("rule_name", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("status", T.BooleanType()), T.StructField("match_mode", T.StringType()), T.StructField("match", T.ArrayType(T.StringType())), T.StructField("match_name", T.StringType()),
    T.StructField("black_list", T.ArrayType(T.StringType())), T.StructField("keyword", T.StringType()), T.StructField("unmatch", T.ArrayType(T.StringType())),
    T.StructField("vul_function", T.StringType()), T.StructField("extractor", T.StringType()),
])
FINDING_SCHEMA = "svid int, rule_name string, language string, level int, path string, line int, code string, reason string, verdict int"


def rule_rows() -> list[dict]:
    return [{"status": True, "match_name": None, "black_list": [], "keyword": None, "unmatch": [], "vul_function": None, "extractor": None} | r for r in _RULES]


def rule(svid: int) -> dict:
    return next(r for r in rule_rows() if r["svid"] == svid)


def rules(spark: SparkSession, languages=None, only=None) -> DataFrame:
    """The rules of these languages (base is always included), or only those with these ids."""
    found = [r for r in rule_rows() if (languages is None or r["language"] in (*languages, "base")) and (only is None or r["svid"] in only)]
    return spark.createDataFrame([tuple(r[f.name] for f in RULE_SCHEMA) for r in found], RULE_SCHEMA)


def tampers(spark: SparkSession) -> DataFrame:
    """(tam_name, tam_type, tam_key, svid): sanitisers with the rules they serve, and inputs."""
    rows = [(n, "Filter-Function", f, s) for n, (filters, _) in TAMPERS.items() for f, svids in filters.items() for s in svids]
    rows += [(n, "Input-Control", i, None) for n, (_, inputs) in TAMPERS.items() for i in inputs]
    return spark.createDataFrame(rows, "tam_name string, tam_type string, tam_key string, svid int")


def languages(spark: SparkSession) -> DataFrame:
    """(ord, language, chiefly, ext)."""
    return spark.createDataFrame([(i, n, c, e) for i, (n, c, es) in enumerate(LANGUAGES) for e in es], "ord int, language string, chiefly boolean, ext string")


def scanned_extensions(spark: SparkSession) -> DataFrame:
    """(language, ext) of the languages that rules cover."""
    return spark.createDataFrame([(n, e) for n, es in EXTENSIONS.items() for e in es], "language string, ext string")


def frameworks(spark: SparkSession) -> DataFrame:
    """(ord, framework, language, kind, marker)."""
    rows = [(i, f[0], f[1], *m) for i, f in enumerate(FRAMEWORKS) for m in f[2:]]
    return spark.createDataFrame(rows, "ord int, framework string, language string, kind string, marker string")


def java_regex(pattern: str) -> str:
    """The pattern in Java's dialect: literal braces escaped; a bare `*` is a literal star."""
    if pattern.startswith("*"):
        pattern = "\\" + pattern
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "[":
            out.append("\\[")
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif c == "{" and not inside and not re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            out.append("\\{")
        elif c == "}" and not inside and not re.search(r"\{\d+(,\d*)?$", "".join(out)):
            out.append("\\}")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def call_regex(match: str, language: str, echo: bool = False) -> str:
    """The pattern of calls of the functions that `match` lists, as the function mode searches for it."""
    if echo:
        return rf"(?:{match})\s*['\"]?(.+?)?\$(.+?)?['\"]?(.+?)?;"
    if language == "javascript":
        return rf"(?:(\A|\s|\b){match})(\s*\((.*)(?:\)))?\b"
    return rf"(?:{match})\s*\((.*)(?:\))"
