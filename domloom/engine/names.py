"""Sets of names from the HTML standard. Fixed values."""

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: What never has children in output, and is never empty for pruning.
VOID_OUTPUT = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    """address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd
    details dialog dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header
    hgroup hr html iframe img input keygen li link listing main marquee menu menuitem meta nav noembed noframes noscript
    object ol p param plaintext pre script search section select source style summary table tbody td template textarea
    tfoot th thead title tr track ul wbr""".split()
)
SPECIAL_MATH = frozenset("mi mo mn ms mtext annotation-xml".split())
SPECIAL_SVG = frozenset("foreignObject desc title".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
THOROUGH_END = IMPLIED_END | frozenset("caption colgroup tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_START = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup
    main menu nav ol p search section summary ul""".split()
)
BLOCK_END = (BLOCK_START - {"p"}) | frozenset("button listing pre".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title".split())
TABLE_TAGS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SCOPE_FOREIGN = frozenset([("math", x) for x in SPECIAL_MATH] + [("svg", x) for x in SPECIAL_SVG])
BREAKOUT = frozenset(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr
    ol p pre ruby s small span strong strike sub sup table tt u ul var""".split()
)
RCDATA = frozenset(["title", "textarea"])
RAWTEXT = frozenset("style xmp iframe noembed noframes script".split())

SVG_TAGS = {
    x.lower(): x
    for x in """altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix
    feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood
    feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight
    feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath""".split()
}
SVG_ATTRS = {
    x.lower(): x
    for x in """attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode
    filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes
    lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength
    patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio
    primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent
    spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength
    viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan""".split()
}
MATH_ATTRS = {"definitionurl": "definitionURL"}
FOREIGN_ATTRS = {
    x: x.replace(":", " ", 1)
    for x in """xlink:actuate xlink:arcrole xlink:href xlink:role xlink:show xlink:title xlink:type xml:lang xml:space
    xmlns:xlink""".split()
}

QUIRKS_PUBLIC = tuple(
    x.strip().lower()
    for x in """+//Silmaril//dtd html Pro v0r11 19970101//
    -//AS//DTD HTML 3.0 asWedit + extensions//
    -//AdvaSoft Ltd//DTD HTML 3.0 asWedit + extensions//
    -//IETF//DTD HTML 2.0 Level 1//
    -//IETF//DTD HTML 2.0 Level 2//
    -//IETF//DTD HTML 2.0 Strict Level 1//
    -//IETF//DTD HTML 2.0 Strict Level 2//
    -//IETF//DTD HTML 2.0 Strict//
    -//IETF//DTD HTML 2.0//
    -//IETF//DTD HTML 2.1E//
    -//IETF//DTD HTML 3.0//
    -//IETF//DTD HTML 3.2 Final//
    -//IETF//DTD HTML 3.2//
    -//IETF//DTD HTML 3//
    -//IETF//DTD HTML Level 0//
    -//IETF//DTD HTML Level 1//
    -//IETF//DTD HTML Level 2//
    -//IETF//DTD HTML Level 3//
    -//IETF//DTD HTML Strict Level 0//
    -//IETF//DTD HTML Strict Level 1//
    -//IETF//DTD HTML Strict Level 2//
    -//IETF//DTD HTML Strict Level 3//
    -//IETF//DTD HTML Strict//
    -//IETF//DTD HTML//
    -//Metrius//DTD Metrius Presentational//
    -//Microsoft//DTD Internet Explorer 2.0 HTML Strict//
    -//Microsoft//DTD Internet Explorer 2.0 HTML//
    -//Microsoft//DTD Internet Explorer 2.0 Tables//
    -//Microsoft//DTD Internet Explorer 3.0 HTML Strict//
    -//Microsoft//DTD Internet Explorer 3.0 HTML//
    -//Microsoft//DTD Internet Explorer 3.0 Tables//
    -//Netscape Comm. Corp.//DTD HTML//
    -//Netscape Comm. Corp.//DTD Strict HTML//
    -//O'Reilly and Associates//DTD HTML 2.0//
    -//O'Reilly and Associates//DTD HTML Extended 1.0//
    -//O'Reilly and Associates//DTD HTML Extended Relaxed 1.0//
    -//SQ//DTD HTML 2.0 HoTMetaL + extensions//
    -//SoftQuad Software//DTD HoTMetaL PRO 6.0::19990601::extensions to HTML 4.0//
    -//SoftQuad//DTD HoTMetaL PRO 4.0::19971010::extensions to HTML 4.0//
    -//Spyglass//DTD HTML 2.0 Extended//
    -//Sun Microsystems Corp.//DTD HotJava HTML//
    -//Sun Microsystems Corp.//DTD HotJava Strict HTML//
    -//W3C//DTD HTML 3 1995-03-24//
    -//W3C//DTD HTML 3.2 Draft//
    -//W3C//DTD HTML 3.2 Final//
    -//W3C//DTD HTML 3.2//
    -//W3C//DTD HTML 3.2S Draft//
    -//W3C//DTD HTML 4.0 Frameset//
    -//W3C//DTD HTML 4.0 Transitional//
    -//W3C//DTD HTML Experimental 19960712//
    -//W3C//DTD HTML Experimental 970421//
    -//W3C//DTD W3 HTML//
    -//W3O//DTD W3 HTML 3.0//
    -//WebTechs//DTD Mozilla HTML 2.0//
    -//WebTechs//DTD Mozilla HTML//""".split("\n")
)
QUIRKS_PUBLIC_EXACT = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
QUIRKS_SYSTEM = "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd"
HTML4 = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
LIMITED = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")
