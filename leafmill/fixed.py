"""Labels, messages, limits and lists that results must reproduce."""

# --- limits of one interactive task; every operator takes them as parameters ---
MAX_ROWS_PER_PAGE = 200
MAX_NODES_PER_FIELD = 100
MAX_CELL_CHARS = 20_000
MAX_PAGE_BYTES = 1024 * 1024
MAX_RUN_BYTES = 5 * 1024 * 1024
MAX_BODY_BYTES = 3 * 1024 * 1024
MAX_PAGES = 10
MAX_REDIRECTS = 5
MIN_INTERVAL_MS = 1000
MAX_CRAWL_DELAY_SECONDS = 10

# --- names that a field may not take ---
RESERVED_NAMES = ["__proto__", "constructor", "prototype", "_source"]
RESERVED_PATH_NAMES = ["__proto__", "constructor", "prototype"]

# --- attributes whose value is a URL ---
URL_ATTRIBUTES = ["href", "src", "data-src", "action", "poster"]

# --- subtrees that never take part in extraction ---
DROPPED_TAGS = ["script", "style", "noscript", "template"]

# --- request headers a rule may not set ---
DENIED_HEADERS = [
    "host",
    "connection",
    "content-length",
    "transfer-encoding",
    "upgrade",
    "te",
    "trailer",
    "keep-alive",
    "proxy-authorization",
    "proxy-authenticate",
    "cookie",
    "set-cookie",
    "accept-encoding",
    "user-agent",
    "expect",
    "origin",
    "referer",
    "forwarded",
]
DENIED_HEADER_PREFIXES = ["sec-", "x-forwarded-", "proxy-"]

# --- resource types a rendered page may load ---
ALLOWED_RESOURCE_TYPES = ["document", "script", "stylesheet", "xhr", "fetch"]

# --- patterns ---
JSON_CONTENT_TYPE = r"(?i)\bapplication/(?:[\w.-]+\+)?json\b"
HTML_CONTENT_TYPE = r"(?i)text/html|application/xhtml\+xml"
CHARSET_PATTERN = r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)"
ATTRIBUTE_PATTERN = r"^(text|[a-zA-Z_:][\w:.-]{0,50})$"
PAGE_PARAM_PATTERN = r"^[a-zA-Z_][\w.-]{0,49}$"

# --- field labels used by rule inference ---
LABEL_TITLE = "标题"
LABEL_LINK = "链接"
LABEL_IMAGE = "图片"
LABEL_PRICE = "价格"
LABEL_DESCRIPTION = "描述"
LABEL_TIME = "时间"
LABEL_CONTENT = "内容"
LABEL_VALUE = "值"
LABEL_FIELD_PREFIX = "字段 "
LABEL_COLUMN_PREFIX = "列 "

# --- selectors tried for a next-page link, first present wins ---
NEXT_SELECTORS = [
    'a[rel="next"]',
    ".next a[href]",
    "a.next[href]",
    'a[aria-label="Next"]',
]

# --- warnings ---
# Notes of a probe report.
NOTE_ONE_PAGE = "仅抓取一页；命中率按实际保留的记录计算。"
NOTE_HTML = "按重复元素和常见语义推断规则，建议试运行后再采集多页。"
NOTE_HTML_NO_LIST = "未发现明显列表，按整页提取；内容由 JavaScript 加载时可尝试动态渲染。"
NOTE_JSON = "按响应结构推断列表和字段，请核对预览后应用。"
NOTE_JSON_EMPTY = "列表为空，暂时无法推断记录内的字段。"
NOTE_JSON_KEYS = "特殊键名可能无法用当前 JSON 路径表达；分页参数需自行填写。"
WARN_NO_CONTAINER = "列表容器未匹配到内容，请检查 CSS 选择器。"
WARN_ROW_CAP = "本页超过 200 条记录，仅保留前 200 条。"
WARN_PAGE_BYTES = "本页提取数据超过 1 MB，仅保留限额内的记录。"
WARN_EMPTY_FIELD_HTML = "「%s」没有提取到内容，请检查选择器或属性。"
WARN_EMPTY_FIELD_JSON = "「%s」没有提取到内容，请核对 JSON 路径。"
WARN_NO_RECORD_JSON = "数据路径没有匹配到记录，可能已到最后一页，请核对接口返回结构。"
WARN_NEXT_INVALID = "下一页链接无效。"
WARN_NEXT_OTHER_ORIGIN = "下一页链接指向其他网站，已停止翻页。"
WARN_NEXT_REPEATED = "检测到重复分页链接，已停止翻页。"
WARN_LANDED_REPEATED = "分页跳转到已采集网页，已停止。"
ERROR_PAGE_OTHER_ORIGIN = "分页跳转到了其他网站，已停止采集。"
WARN_RUN_BYTES = "任务数据达到 5 MB 上限，已停止采集。"
WARN_INTERRUPTED = "连接意外中断，已采集的数据仍可导出。"
WARN_STOPPED = "用户已停止任务，保留已获取的数据。"
WARN_RESOURCE_FAILED = "%d 个渲染资源加载失败或未通过访问检查，动态内容可能不完整。"
WARN_RESOURCE_BLOCKED = "已跳过 %d 个图片、媒体、非 GET 请求或额外导航；依赖这些请求的内容可能缺失。"

# --- charset labels and the JVM charset each one means; other labels read as UTF-8 ---
CHARSETS = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "us-ascii": "windows-1252",
    "ascii": "windows-1252",
    "iso-8859-1": "windows-1252",
    "latin1": "windows-1252",
    "windows-1252": "windows-1252",
    "cp1252": "windows-1252",
    "iso-8859-2": "ISO-8859-2",
    "iso-8859-3": "ISO-8859-3",
    "iso-8859-4": "ISO-8859-4",
    "iso-8859-5": "ISO-8859-5",
    "iso-8859-6": "ISO-8859-6",
    "iso-8859-7": "ISO-8859-7",
    "iso-8859-8": "ISO-8859-8",
    "iso-8859-9": "windows-1254",
    "iso-8859-13": "ISO-8859-13",
    "iso-8859-15": "ISO-8859-15",
    "windows-1250": "windows-1250",
    "windows-1251": "windows-1251",
    "windows-1253": "windows-1253",
    "windows-1254": "windows-1254",
    "windows-1255": "windows-1255",
    "windows-1256": "windows-1256",
    "windows-1257": "windows-1257",
    "windows-1258": "windows-1258",
    "windows-874": "x-windows-874",
    "koi8-r": "KOI8-R",
    "koi8-u": "KOI8-U",
    "ibm866": "IBM866",
    "gbk": "GBK",
    "gb2312": "GBK",
    "gb18030": "GB18030",
    "big5": "Big5",
    "shift_jis": "windows-31j",
    "sjis": "windows-31j",
    "euc-jp": "EUC-JP",
    "iso-2022-jp": "ISO-2022-JP",
    "euc-kr": "x-windows-949",
    "ks_c_5601-1987": "x-windows-949",
    "utf-16": "UTF-16LE",
    "utf-16le": "UTF-16LE",
    "utf-16be": "UTF-16BE",
}

# --- address blocks that are not plain public unicast ---
SPECIAL_IPV4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.31.196.0/24",
    "192.52.193.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "192.175.48.0/24",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
]
SPECIAL_IPV6 = [
    "::/128",
    "::1/128",
    "::ffff:0:0:0/96",
    "64:ff9b::/96",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "2620:4f:8000::/48",
    "fc00::/7",
    "fe80::/10",
    "ff00::/8",
]
LOCAL_SUFFIXES = [".localhost", ".local", ".internal"]
