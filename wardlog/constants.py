"""Values fixed by the data model: they must be exactly these for results to agree."""

# HTTP verbs counted by the method profile, in output order.
METHODS = [
    "GET", "HEAD", "PUT", "POST", "OPTIONS", "DELETE",
    "TRACE", "CONNECT", "PATCH", "REPORT", "PROPFIND",
]

# Output column -> text looked for anywhere in the status code.
STATUS_MARKS = {
    "info_st": "10",
    "succ_st": "20",
    "redir_st": "30",
    "cler_st": "40",
    "serer_st": "50",
}

# Login service codes counted one by one.
LOGIN_CODES = ["H0015", "H0020", "H1001", "H5010", "A1000"]
A_SERVICE = "A1000"
H_SERVICE = "H1001"

# Words dropped before text features are built.
STOP_WORDS = [
    "bbs", "write", "modify", "board", "delete",
    "id", "contents", "writer", "page",
]

# Fixed values: (column, LIKE pattern on its lower-cased text), in order; the first match counts.
SIGNATURES = [
    ("http_path", "%cgi-%"),
    ("http_path", "%.php"),
    ("http_path", "%..%2f%"),
    ("http_path", "%..%255c%"),
    ("http_path", "%..%252f%"),
    ("http_path", "%php%admin%"),
    ("http_query", "%..%/%..%/%"),
    ("http_query", "%etc%passwd%"),
    ("http_query", "%etc%shadow%"),
    ("http_query", "%etc%hosts%"),
    ("http_query", "%etc%shells%"),
    ("http_query", "%wp-includes%"),
    ("http_query", "%wp-admin%"),
    ("http_query", "%wp-content%"),
    ("http_query", "%ftp://%"),
    ("http_query", "%.hta%"),
]

# Alternatives of the injection pattern (lower-cased query).
INJECTION_TERMS = [
    "information_schema", "table_name", "order[ \t\n\r\f]+by", "file_get_contents",
    "%c0%ae", "require_once", "declare", "exec.+master", "navigateandfind",
    "procedure", "xp_cmdshell", "passthru", "benchmark", "sessionstorage",
    "postmessage", "constructor", "setimmediate", "settimeout", "load_file",
    "concat", "union.*select", "ls -[a-z]*", "nc -[lvp]*", "rm.*-rf", "%00", "%zz",
    "ysaccessobjects", "msysaces", "msysobjects", "msysqueries",
    "msysrelationships", "msysaccessstorage", "msysaccessxml", "msysmodules",
    "msysmodules2", "aster[.][.]sysdatabases", "ysql[.]db", "[.]database_name",
    "qlite(_temp)?_master", "pg_(catalog|toast)", "northwind", "tempdb",
    "nslookup", "sysdate",
]

# Agent names of scanners and parameter names of log-in forms.
SCANNER_TERMS = [
    "metasploit", "nmap", "shodan", "pharos", "botnet", "owasp", "openvas", "nessus",
]
CREDENTIAL_TERMS = ["user_pass", "user_login", "user_id", "userid%passwd"]

# Fixed value: a tag made of these characters only (no blank, brace or bar inside).
XSS_TAG = r"<+[a-z0-9~!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`]*>"

# Training label in the log -> class name.
TRAIN_LABELS = {
    "BEACONING": "file_download",
    "SQL_INJECTION": "injection",
    "CREDENTIAL": "credential",
    "XSS": "xss",
}

# Class name -> display name -> result code.
DISPLAY_NAMES = {
    "credential": "CREDENTIAL",
    "injection": "SQL_INJECTION",
    "xss": "XSS",
    "file_download": "FILE_DOWNLOAD",
    "normal": "NORMAL",
    "anomaly": "ANOMALY",
}
RESULT_CODES = {
    "NORMAL": 0,
    "CREDENTIAL": 1,
    "SQL_INJECTION": 2,
    "XSS": 3,
    "FILE_DOWNLOAD": 4,
    "ANOMALY": 5,
}

# Result table columns, in order.
RESULT_COLUMNS = [
    "model_id", "logtime", "end", "rule", "src_ip", "dst_ip", "src_ip_country_code",
    "dst_ip_country_code", "ast_ip", "related_ip", "direction_inout",
    "direction_inout_bin", "related_country", "att_name", "result", "probs",
    "anomaly_score", "feedback", "packet", "if_label", "if_score", "lof_label",
    "lof_score", "ai_label", "ai_score",
]

# Keyword pool of the synthetic payload texts.
SQL_KEYWORDS = [
    "union", "drop", "insert", "create", "merge", "all", "select", "as",
    "from", "table", "where", "and", "or", "in", "like", "limit",
]

# Vocabulary caps per column in capped mode.
VOCABULARY_CAPS = {"http_host": 10, "http_agent": 250, "http_query": 2500}

# Fixed value: box-plot multiplier of the anomaly threshold.
BOX_MULTIPLIER = 26
