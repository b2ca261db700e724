"""Fixed values that the results depend on: word lists, label tables, limits."""

# Words that mark boilerplate.
BOILERPLATE_KEYWORDS = (
    "cookie", "privacy", "terms", "service", "policy", "gdpr", "consent", "accept", "decline",
    "manage", "preferences", "tracking", "advertisement", "subscribe", "newsletter", "login",
    "sign up", "register", "password", "forgot", "reset", "error", "404", "not found",
    "access denied", "loading", "please wait", "javascript", "enable", "browser", "update",
    "redirect", "continue", "click here", "read more", "learn more",
)

# Quality limits.
MIN_CONTENT_CHARS = 250
MIN_UNTITLED_WORDS = 50
MAX_BOILERPLATE_RATIO = 0.3

# Language limits and codes.
MIN_LANGUAGE_BYTES = 50
MIN_LANGUAGE_CONFIDENCE = 0.25
LANGUAGE_CODES = {
    "eng": "en", "rus": "ru", "cmn": "zh", "spa": "es", "fra": "fr", "deu": "de", "jpn": "ja",
    "kor": "ko", "por": "pt", "ita": "it", "nld": "nl", "pol": "pl", "tur": "tr", "swe": "sv",
    "dan": "da", "fin": "fi", "heb": "he", "ara": "ar", "hin": "hi", "tha": "th", "vie": "vi",
}

# Fetch limits.
MAX_BODY_BYTES = 5 * 1024 * 1024
MAX_REDIRECTS = 10
CHARSET_SNIFF_BYTES = 4096
ACCEPTED_TYPES = ("text/html", "application/xhtml")
FATAL_FETCH_ERRORS = ("InvalidUrl", "BodyTooLarge", "UnsupportedContentType", "Charset")

# Where the main content of a page is looked for, in order.
CONTENT_SELECTORS = (
    "article", "main", "[role='main']", ".content", ".post", ".article", "#content", "#main",
    ".entry-content",
)
MIN_MAIN_CONTENT_BYTES = 100

# Web encoding labels (WHATWG Encoding Standard) of the charsets that are told apart.
CHARSET_LABELS = {
    "Utf8": (
        "unicode-1-1-utf-8", "unicode11utf8", "unicode20utf8", "utf-8", "utf8", "x-unicode20utf8",
    ),
    "Windows1252": (
        "ansi_x3.4-1968", "ascii", "cp1252", "cp819", "csisolatin1", "ibm819", "iso-8859-1",
        "iso-ir-100", "iso8859-1", "iso88591", "iso_8859-1", "iso_8859-1:1987", "l1", "latin1",
        "us-ascii", "windows-1252", "x-cp1252",
    ),
    "ShiftJis": (
        "csshiftjis", "ms932", "ms_kanji", "shift-jis", "shift_jis", "sjis", "windows-31j", "x-sjis",
    ),
    "Gb2312": (
        "chinese", "csgb2312", "csiso58gb231280", "gb18030", "gb2312", "gb_2312", "gb_2312-80",
        "gbk", "iso-ir-58", "x-gbk",
    ),
    "Big5": ("big5", "big5-hkscs", "cn-big5", "csbig5", "x-x-big5"),
}

# The remaining labels of the same standard; their texts are read as UTF-8.
OTHER_CHARSET_LABELS = (
    "866", "cp866", "csibm866", "ibm866",
    "csisolatin2", "iso-8859-2", "iso-ir-101", "iso8859-2", "iso88592", "iso_8859-2", "iso_8859-2:1987", "l2", "latin2",
    "csisolatin3", "iso-8859-3", "iso-ir-109", "iso8859-3", "iso88593", "iso_8859-3", "iso_8859-3:1988", "l3", "latin3",
    "csisolatin4", "iso-8859-4", "iso-ir-110", "iso8859-4", "iso88594", "iso_8859-4", "iso_8859-4:1988", "l4", "latin4",
    "csisolatincyrillic", "cyrillic", "iso-8859-5", "iso-ir-144", "iso8859-5", "iso88595", "iso_8859-5", "iso_8859-5:1988",
    "arabic", "asmo-708", "csiso88596e", "csiso88596i", "csisolatinarabic", "ecma-114", "iso-8859-6", "iso-8859-6-e",
    "iso-8859-6-i", "iso-ir-127", "iso8859-6", "iso88596", "iso_8859-6", "iso_8859-6:1987",
    "csisolatingreek", "ecma-118", "elot_928", "greek", "greek8", "iso-8859-7", "iso-ir-126", "iso8859-7", "iso88597",
    "iso_8859-7", "iso_8859-7:1987", "sun_eu_greek",
    "csiso88598e", "csisolatinhebrew", "hebrew", "iso-8859-8", "iso-8859-8-e", "iso-ir-138", "iso8859-8", "iso88598",
    "iso_8859-8", "iso_8859-8:1988", "visual", "csiso88598i", "iso-8859-8-i", "logical",
    "csisolatin6", "iso-8859-10", "iso-ir-157", "iso8859-10", "iso885910", "l6", "latin6",
    "iso-8859-13", "iso8859-13", "iso885913", "iso-8859-14", "iso8859-14", "iso885914",
    "csisolatin9", "iso-8859-15", "iso8859-15", "iso885915", "iso_8859-15", "l9", "iso-8859-16",
    "cskoi8r", "koi", "koi8", "koi8-r", "koi8_r", "koi8-ru", "koi8-u",
    "csmacintosh", "mac", "macintosh", "x-mac-roman", "x-mac-cyrillic", "x-mac-ukrainian",
    "dos-874", "iso-8859-11", "iso8859-11", "iso885911", "tis-620", "windows-874",
    "cp1250", "windows-1250", "x-cp1250", "cp1251", "windows-1251", "x-cp1251", "cp1253", "windows-1253", "x-cp1253",
    "cp1254", "csisolatin5", "iso-8859-9", "iso-ir-148", "iso8859-9", "iso88599", "iso_8859-9", "iso_8859-9:1989", "l5",
    "latin5", "windows-1254", "x-cp1254", "cp1255", "windows-1255", "x-cp1255", "cp1256", "windows-1256", "x-cp1256",
    "cp1257", "windows-1257", "x-cp1257", "cp1258", "windows-1258", "x-cp1258",
    "cseucpkdfmtjapanese", "euc-jp", "x-euc-jp", "csiso2022jp", "iso-2022-jp",
    "cseuckr", "csksc56011987", "euc-kr", "iso-ir-149", "korean", "ks_c_5601-1987", "ks_c_5601-1989", "ksc5601", "ksc_5601",
    "windows-949", "csiso2022kr", "hz-gb-2312", "iso-2022-cn", "iso-2022-cn-ext", "iso-2022-kr", "replacement",
    "unicodefffe", "utf-16be", "csunicode", "iso-10646-ucs-2", "ucs-2", "unicode", "unicodefeff", "utf-16", "utf-16le",
    "x-user-defined",
)

# Names of the encodings in error messages.
ENCODING_NAMES = {"Utf8": "UTF-8", "Windows1252": "windows-1252", "ShiftJis": "Shift_JIS", "Gb2312": "GBK", "Big5": "Big5", "Other": "UTF-8"}

# Default ports of the web schemes.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# Entities decoded by the column form of tag stripping.
COLUMN_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©",
    "&middot;": "·",
}

# Markup that survives sanitising. The list is this package's own choice.
SAFE_TAGS = frozenset(
    "a abbr article aside b blockquote br caption cite code col colgroup dd del details div dl dt em "
    "figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q s samp "
    "section small span strong sub summary sup table tbody td tfoot th thead time tr tt u ul var".split()
)
SAFE_ATTRIBUTES = {
    "a": ("href", "hreflang"), "img": ("src", "alt", "width", "height"), "blockquote": ("cite",),
    "q": ("cite",), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan"), "time": ("datetime",),
    "ol": ("start",), "*": ("title", "lang"),
}
SAFE_SCHEMES = ("http", "https", "mailto", "ftp", "tel")
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
