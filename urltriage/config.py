"""Fixed values of the two rule sets: word lists, weights, thresholds.

Everything here is data.  It reaches the plans as literals, so Catalyst folds
it into the expressions and nothing is shipped to the executors separately.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Domain-risk dictionaries
# --------------------------------------------------------------------------
HIGH_RISK_SUFFIXES = ("xyz", "top", "tk", "ga", "ml", "cf")
LOW_RISK_SUFFIXES = ("cn", "ru", "info", "io", "cc", "im", "ai")

HIGH_CONFIDENCE_WORDS = (
    "login", "signin", "sign-in", "sign_in", "verify", "verification", "validate",
    "password", "pwd", "passwd", "reset", "reset-password", "confirm", "confirm-account",
    "account", "secure", "secure-login", "auth", "authentication", "verify-account",
    "unlock", "security-update", "account-security", "secure-access", "access",
)
PROMO_WORDS = (
    "free", "gratis", "discount", "descuento", "sale", "venta", "oferta", "ofertas",
    "promo", "promocion", "promoción", "coupon", "cupon", "voucher", "rebaja",
    "clearance", "liquidacion", "outlet", "cheap", "barato", "deal", "deals",
    "black friday", "cyber monday", "flash sale", "super oferta",
)
SITE_URGENCY_WORDS = (
    "limited", "limited time", "hurry", "act now", "last chance", "expires", "vence",
    "ahora", "urgente", "solo hoy", "hoy", "ultimo dia", "último día", "offer ends",
    "ends soon", "aprovecha",
)
ANTI_PHISHING_WORDS = (
    "phishtank", "virustotal", "safe", "safe browsing", "blocklist",
    "threat", "security", "whois", "dnslytics", "urlscan", "opendns", "abuse",
    "phishing", "blacklist", "scam", "fake", "remove", "how", "learn",
    "tutorial", "guide", "awareness", "identify", "spot", "avoid", "warning",
    "beware", "alert", "faq", "support", "help", "report", "checker",
)
IRRELEVANT_WORDS = (
    "forum", "reddit", "support", "help", "discussion", "community", "news",
    "blog", "faq", "wiki", "article", "post", "how to", "how-to", "tutorial",
    "guide", "fix", "hc/en-us", "articles", "forgotten", "parental", "linking",
)
IRRELEVANT_DOMAINS = (
    "reddit.com", "quora.com", "wikipedia.org", "medium.com",
    "stackoverflow.com", "youtube.com", "facebook.com", "instagram.com",
    "x.com", "tiktok.com", "amazon.com",
)
TRUSTED_DOMAINS = ("apple.com", "microsoft.com", "google.com", "amazon.com", "facebook.com")
TRUSTED_URL_PATTERNS = (
    r"^([a-z0-9-]+\.)*[a-z0-9-]+\.(com|net)/?$",
    r"^([a-z0-9-]+\.)*[a-z0-9-]+\.(com|net)/(support|app|news|docs|community|blog|tickets|faq"
    r"|about|store|products|account|login|kb|help|answers|rewards)/.*$",
)
LEGIT_SUBDOMAIN_PATTERN = r"^([a-z0-9-]+\.)+[a-z0-9-]+\.(com|net)(/.*)?$"
TRUSTED_NAMESERVER_WORDS = (
    "cloudflare", "awsdns", "googledomains", "akam", "fastly", "dnsmadeeasy", "nsone",
    "rackspace", "dnsimple", "verisign", "godaddy", "namecheap",
)
KNOWN_DOMAINS = (
    "paypal.com", "apple.com", "microsoft.com", "google.com", "amazon.com",
    "facebook.com", "twitter.com", "netflix.com", "bankofamerica.com", "chase.com",
)
SUSPICIOUS_SUBDOMAIN_WORDS = ("login", "secure", "account", "verify")

# Domain-risk weights
CREATION_MIN_DAYS = 180
CREATION_POINTS = 20
NO_EMAIL_POINTS = 8
NO_REGISTRAR_POINTS = 12
HIGH_RISK_SUFFIX_POINTS = 45
LOW_RISK_SUFFIX_POINTS = 12
NO_MX_POINTS = 12
SHORT_TTL_SECONDS = 300
SHORT_TTL_POINTS = 10
NO_IP_POINTS = 10
FEW_NS_POINTS = 10
UNTRUSTED_NS_POINTS = 10
MANY_IPS_LIMIT = 5
MANY_IPS_POINTS = 10
NO_HTTPS_POINTS = 12
SIMILAR_DOMAIN_POINTS = 40
SIMILAR_MAX_LENGTH_GAP = 6
SIMILAR_MIN_LEVENSHTEIN = 0.9
SIMILAR_MIN_JARO_WINKLER = 0.95
HIGH_CONFIDENCE_BRAND_POINTS = 30
HIGH_CONFIDENCE_STRONG_POINTS = 18
HIGH_CONFIDENCE_ALONE_POINTS = 4
PROMO_BRAND_POINTS = 6
PROMO_POINTS = 3
URGENCY_POINTS = 4
URGENCY_ALONE_POINTS = 2
SUSPICIOUS_SUBDOMAIN_POINTS = 8
SUSPICIOUS_THRESHOLD = 50
FACTS_MAX_AGE_DAYS = 7

# --------------------------------------------------------------------------
# Page-risk dictionaries
# --------------------------------------------------------------------------
SUSPICIOUS_SUFFIXES = (
    "top", "tk", "xyz", "cf", "ga", "ml", "pw", "cc", "vip", "biz", "club", "online", "site",
    "work", "shop", "store", "website", "io", "link", "today", "bid", "date", "win", "win99",
)
TRUSTED_ISSUERS = (
    "Let's Encrypt", "DigiCert Inc", "Sectigo Limited", "Google Trust Services",
    "Amazon", "GlobalSign nv-sa", "GoDaddy.com, Inc.",
)
CREDENTIAL_KEYWORDS = (
    "login", "signin", "sign-in", "sign_in", "verify", "verification", "validate",
    "password", "passwd", "pwd", "account", "unlock", "confirm", "confirm-account",
    "secure-login", "secure-access", "auth", "authentication", "user", "username",
    "email", "correo", "verify-account", "free-gift", "account-verification",
)
ECOMMERCE_KEYWORDS = (
    "cart", "checkout", "buy", "order", "payment", "invoice", "shipping", "track",
    "voucher", "coupon", "discount", "promo", "offer", "sale", "clearance",
    "carrito", "pagar", "comprar", "pedido", "envio", "factura", "rastreo",
    "descuento", "promocion", "oferta", "cupon",
)
URGENCY_KEYWORDS = (
    "urgent", "expires", "limited", "act now", "last chance", "hurry", "only today",
    "solo hoy", "ahora", "urgente", "expira", "limitado", "aprovecha", "ultimo",
    "oferta por tiempo", "final sale", "exclusive offer",
)
PHISHING_KEYWORDS = (
    "free gift", "win prize", "claim now", "verify account", "update payment",
    "secure your account", "login to claim", "exclusive deal", "limited stock",
    "regalo gratis", "gana premio", "reclamar ahora", "verificar cuenta",
    "actualizar pago", "asegura tu cuenta", "secure payment", "account suspended",
    "login required",
)
REPLICA_KEYWORDS = (
    "replica", "aaa quality", "super copy", "wholesale", "cheap {brand}", "100% original",
    "fake", "counterfeit", "reproduction", "knockoff", "repe", "dupe",
)
KEYWORD_FAMILIES = {
    "credential": CREDENTIAL_KEYWORDS,
    "ecommerce": ECOMMERCE_KEYWORDS,
    "urgency": URGENCY_KEYWORDS,
    "phishing": PHISHING_KEYWORDS,
    "replica": REPLICA_KEYWORDS,
}
SNIPPET_FAMILIES = ("credential", "ecommerce", "urgency", "phishing")

SUSPICIOUS_INPUT_WORDS = ("card_number", "credit_card", "cvv", "card_expiry", "billing")
INFORMATIONAL_PATTERNS = (
    "how to", "how-to", "guide", "tutorial", "avoid", "identify", "scam", "scam alert",
    "warning", "protect yourself", "blog", "news",
)
PLATFORM_DOMAINS = (
    "play.google.com", "apps.apple.com", "amazon.com", "microsoft.com", "nordstrom.com",
    "nordstromrack.com", "zappos.com", "coupons.com", "usatoday.com", "footlocker.com",
    "falabella.com.pe", "cnn.com", "yahoo.com", "businessinsider.com", "runnersworld.com",
    "wired.com", "travelandleisure.com", "tomsguide.com", "slickdeals.net",
    "promodescuentos.com", "foxdeportes.com", "sportico.com.mx", "deporte-outlet.es",
    "marti.mx", "dportenis.mx", "diadora.com", "championmexico.com.mx",
)
BRAND_WHITELIST = (
    ("cipriani", "cipriani.com"),
    ("cipriani", "ciprianidrinks.com"),
    ("cipriani", "ciprianiresidencesmiami.com"),
    ("cipriani", "mrchotels.com"),
    ("cipriani", "mrccoconutgrove.com"),
    ("cipriani", "bellinirestaurant.com"),
    ("cipriani", "ciprianienergygroup.com"),
    ("casa_cipriani", "casacipriani.com"),
    ("casa_cipriani", "casacipriani.com/miami"),
    ("casa_cipriani", "casacipriani.com/milano"),
    ("bellini", "cipriani.com/bellini"),
    ("bellini", "ciprianidrinks.com/en/bellini"),
    ("mrc", "mrchotels.com"),
    ("mrc", "mrccoconutgrove.com"),
    ("berlini", "bellinirestaurant.com"),
)
MIN_TEXT_LENGTH = 200


@dataclass(frozen=True)
class PageWeights:
    """Weights of the page-risk rules; replace single ones to tune."""

    brand_in_domain: float = -0.7
    exact_brand_domain: float = -1.0
    brand_in_path: float = 0.03
    password_input: float = 0.35
    form_action_external: float = 0.4
    many_forms: float = 0.2
    credential_keywords: float = 0.4
    ecommerce_keywords: float = 0.02
    urgency_keywords: float = 0.2
    phishing_keywords: float = 0.45
    replica_keywords: float = 0.6
    suspicious_payment: float = 0.7
    contact_info_suspicious: float = 0.4
    multi_brand_detected: float = 0.5
    images_logo_match: float = -0.4
    suspicious_suffix: float = 0.25
    typo_similar_brand: float = 0.5
    external_links_ratio: float = 0.25
    low_text_to_form_ratio: float = 0.3
    informational_context: float = -0.5
    whitelisted_platform: float = -1.0
    https_missing: float = 0.3
    domain_young: float = 0.4
    ssl_invalid: float = 0.45
    ssl_young: float = 0.3
    ssl_untrusted_issuer: float = 0.35
    high_img_low_text: float = 0.3


@dataclass(frozen=True)
class PageRiskOptions:
    weights: PageWeights = field(default_factory=PageWeights)
    # The contact check has no producer; an absent value counts as suspicious.
    default_contact_suspicious: bool = True
    # Lets one phishing keyword count when the brand is in a snippet.
    snippet_arm: bool = False


# --------------------------------------------------------------------------
# Candidate search
# --------------------------------------------------------------------------
QUERY_TEMPLATES = (
    "{brand} comprar", "{brand} oferta", "{brand} tienda", "{brand} descuento",
    "{brand} promo", "{brand} outlet", "{brand} sale", "{brand} login", "{brand} shop",
    "{brand} deals", "{brand} clearance", "{brand} rebajas", "{brand} promociones",
    "{brand} black friday", "{brand} cyber monday", "restaurante {brand}", "hotel {brand}",
    "residencias {brand}", "cóctel {brand}", "bebidas {brand}", "eventos {brand}",
    "club privado {brand}", "compra online {brand}", "reservas {brand}",
    "ofertas hotel {brand}", "promociones restaurante {brand}", "{brand} buy",
    "{brand} offer", "{brand} shop", "{brand} discount", "{brand} promo", "{brand} outlet",
    "{brand} sale", "{brand} login", "{brand} drinks", "{brand} restaurant",
    "{brand} hotel", "{brand} reservations", "{brand} deals", "{brand} promotions",
    "{brand} online booking",
)
NEWS_AND_SOCIAL_HOSTS = (
    "wikipedia.org", "facebook.com", "instagram.com", "x.com", "linkedin.com", "youtube.com",
    "tiktok.com", "reddit.com", "bing.com", "google.com", "apple.com",
)
SEARCH_ENGINE_HOSTS = ("duckduckgo.com", "bing.com")

# Small rule table for registrable domains; pass a full public list as a table
# when one is at hand.
DEFAULT_SUFFIXES = tuple(
    (s, "exact")
    for s in (
        "com net org info biz edu gov mil int io ai cc co tv me im pw tk ga ml cf gq ws xyz top "
        "club online site shop store website work link today bid date win vip app dev page blog "
        "es mx pe ar cl br ve ec uy it fr de uk us ca ru cn jp in au nz za eu ch at be nl se no "
        "com.pe com.mx com.ar com.co com.br com.ve com.ec com.uy com.cn com.au com.es co.uk "
        "org.uk ac.uk gov.uk co.jp co.in co.nz co.za org.pe edu.pe gob.pe gob.mx org.mx org.br "
        "net.br org.au net.au"
    ).split()
) + (("*.ck", "wildcard"), ("www.ck", "exception"))
