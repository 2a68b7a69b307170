"""Fixed values. Results depend on these exact words, patterns and numbers."""

# Spelled-out numbers (the articles "um" and "uma" are left out on purpose).
NUMBER_WORDS = [
    "dois", "duas", "três", "quatro", "cinco", "seis", "sete", "oito", "nove", "dez", "onze", "doze",
    "treze", "catorze", "quatorze", "quinze", "dezesseis", "dezessete", "dezoito", "dezenove", "vinte",
    "trinta", "quarenta", "cinquenta", "sessenta", "setenta", "oitenta", "noventa", "cem", "cento",
    "duzentos", "trezentos", "quatrocentos", "quinhentos", "mil", "milhão", "milhões", "bilhão",
    "bilhões", "trilhão", "trilhões", "metade", "dobro", "triplo", "dúzia", "dezena", "dezenas",
    "centena", "centenas",
]

# News outlets masked as FONTE.
OUTLET_WORDS = [
    "g1", "globo", "folha", "estadão", "estadao", "uol", "veja", "band", "sbt", "record", "r7", "cnn",
    "reuters", "afp", "ansa", "bbc", "valor", "exame", "istoé", "época", "jovem pan", "agência", "agencia",
]

# Time words masked as TEMPO.
TIME_WORDS = [
    "hoje", "ontem", "amanhã", "segunda", "terça", "quarta", "quinta", "sexta", "sábado", "domingo",
    "feira", "nesta", "neste", "desta", "deste", "nessa", "nesse", "dessa", "desse", "janeiro",
    "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro",
    "novembro", "dezembro",
]

# Political words masked as POL.
POLITICAL_WORDS = [
    "pt", "psdb", "pmdb", "mdb", "psol", "psl", "dem", "pcdob", "petista", "petistas", "tucano",
    "tucanos", "peemedebista", "comunista", "comunistas", "esquerda", "direita", "esquerdista",
    "esquerdistas", "socialista", "bolsonarista", "lulista", "senado", "senador", "senadora",
    "senadores", "deputado", "deputada", "deputados", "câmara", "stf", "tse", "tcu", "ministro",
    "ministra", "presidente", "presidenta", "governo", "planalto", "congresso", "impeachment", "lava",
    "jato", "corrupção", "propina", "reforma", "previdência",
]

# Fact-check vocabulary, as whole-word alternatives.
CHECK_VOCABULARY = (
    r"fake|falso|falsa|boato|checagem|verifica|enganos[oa]|desmentid[oa]|viraliz\w*|circula\w*|mentira"
)

# Older fact-check vocabulary, matched with case kept.
CHECK_VOCABULARY_OLD = (
    r"fake|falso|falsa|boato|checagem|verificar|enganoso|desmentir|viralizar|viralizado"
)

# Openings typical of a fact-checker describing the checked object.
DESCRIPTION_OPENINGS = (
    r"publica\w*|post\w*|mensage\w*|v[ií]deo\w*|imagem|imagens|foto\w*|texto|montagem|print|corrente|"
    r"[áa]udio|tu[íi]te|tweet|meme|card|alega\w*|boato"
)

# Outlet keys looked up inside a domain, first hit wins.
OUTLET_KEYS = [
    "diariodobrasil", "afolhabrasil", "thejornalbrasil", "ceticismopolitico", "topfivetv", "g1.globo",
    "estadao", "folha",
]
OUTLET_DEFAULT = "outros_true"

# Text kinds.
KIND_TRUE = "true_resumida"
KIND_QUOTED = "fake_boato_citado"
KIND_CHECK = "fake_texto_checagem"
KIND_OTHER = "fake_outros"

# Part-of-speech tags kept as function words, and modal lemmas.
FUNCTION_POS = ["ADP", "DET", "PRON", "CCONJ", "SCONJ", "AUX", "PART"]
MODAL_LEMMAS = ["poder", "dever", "querer"]
ENTITY_TYPES = ["PER", "ORG", "LOC", "MISC"]

# Page extraction.
EMBED_CLASSES = ["instagram-media", "tiktok-embed", "twitter-tweet", "wp-embedded-content"]
NAVIGATION_OPENINGS = r"leia (?:também|mais)|veja (?:também|mais)|assista|📲|siga o|clique aqui"
LEADING_SYMBOLS = "➡▶►•✅📌🔴"

# Columns that give away the class or the source.
LEAK_COLUMNS = ["author", "link", "date", "category", "pair_id"]

# Number categories, in report order.
NUMBER_CATEGORIES = ["year", "percent", "money", "time_or_date", "other_digit", "spelled"]

# Rejection reasons.
REASON_SHORT = "abaixo do mínimo de palavras"
REASON_REPEATED = "quase idêntico a outro item do teste 2 (texto-modelo/repetido)"
REASON_KNOWN = "quase idêntico a texto do corpus ou do teste 1"
REASON_NOT_ARTICLE = "não é /noticia/"
REASON_NO_EXCERPT = "sem trecho extraído"
