"""Values that decide which contacts come out; changing one changes results."""

import string

# --- Fixed values: word lists -------------------------------------------------

FORBIDDEN_WORDS = [
    'user', 'users', 'test', 'example', 'demo', 'sample', 'dummy', 'temp', 'trial', 'no-reply', 'noreply'
]

FORBIDDEN_LOCAL_WORDS = [
    'user', 'test', 'demo', 'example', 'sample', 'dummy', 'temp', 'trial', 'no-reply', 'noreply'
]

# --- Fixed values: file-name extensions -------------------------------------------

LOOKALIKE_EXTENSIONS = [
    '.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.svg', '.webp', '.ico',
    '.pdf', '.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.zip', '.rar'
]

IMAGE_EXTENSIONS = ['jpg', 'png', 'gif', 'bmp', 'tiff', 'jpeg']

COMPATIBLE_EXTENSIONS = [
    '.txt', '.log', '.ini', '.inf', '.html', '.htm', '.asp', '.aspx', '.php', '.js', '.json', '.xml', '.yaml', '.yml', '.md',
    '.csv', '.xls', '.xlsx', '.xlsm', '.ods',
    '.docx', '.docm', '.doc', '.rtf', '.odt',
    '.pptx', '.ppt',
    '.pdf',
    '.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.gif',
    '.sqlite', '.sqlite3', '.db', '.sql', '.mdb', '.accdb',
    '.eml', '.msg',
    '.zip', '.tar', '.gz', '.rar'
]

# --- Fixed values: e-mail patterns as plain regular expressions ---------------------

STRICT_EMAIL = r'\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}\b'
BOUNDED_EMAIL = r'(?<![\w.-])([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)(?![\w.-])'
LOOSE_EMAIL = r'[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+'

# --- Fixed values: where a link starts, which characters end it, what is cut off its end

URL_START = r'https?://'

SEGMENTED_STOPS = r'\s"\'<>{}$'
OVERLAPPING_STOPS = r' \'",\n\r\t<>\[\](){};|'
SERVICE_STOPS = r'\s\'",<>${}()|'

SEGMENTED_TRAIL = '.,;:)}]>\'"'
OVERLAPPING_TRAIL = '.,;\'"!?)]}'
SERVICE_TRAIL = '.,;\'"!?)]}'

OVERLAPPING_MIN_LENGTH = 10     # kept from this length on
SERVICE_MIN_LENGTH = 11         # kept from this length on

# --- Fixed values: character sets -----------------------------------------------

PUNCTUATION = string.punctuation

# What counts as white space when list entries are stripped.
WHITESPACE = (
    '\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 '
    '           '
    '    　'
)

# Characters whose NFKC form holds one of / ? # @ : and so make a network location invalid.
NETLOC_LOOKALIKES = (
    '⁇⁈⁉℀℁℅℆⩴︓︖'
    '﹕﹖﹟﹫＃／：？＠'
)

# --- Fixed values: output formats ------------------------------------------------

MAPPING_CSV_HEADER = ['Domain/Subdomain', 'URLs']
MAPPING_JOINER = '; '

# Extensions read as text, opened as archives, and opened as office files.
TEXT_EXTENSIONS = [
    '.txt', '.log', '.ini', '.inf', '.html', '.htm', '.asp', '.aspx', '.php', '.js', '.json',
    '.xml', '.yaml', '.yml', '.md', '.sql'
]
ARCHIVE_EXTENSIONS = ['.zip', '.tar', '.gz', '.rar']
OFFICE_EXTENSIONS = ['.docx', '.docm', '.xlsx', '.xlsm', '.pptx', '.odt', '.ods']
