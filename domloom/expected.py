"""Results of the literal pages of cases.py, by the HTML standard and the documented behaviour; row n is page n. Fixed values."""

EXPECTED = {
    "each_edit": [
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\" id=\"q\" hidden>a <b>b</b>  c<!--n--></p><p id=\"q\" hidden> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a b  c<!--n--></p><p> </p><svg><path></path></svg>www.y.org</body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\"></p><p></p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b data-seen=\"1\">b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\" data-seen=\"1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\"><b>b</b>  c<!--n--><p class=\"k l\" kids=\"False True new\"></p></p><p class=\"k l\">new<i></i><b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body>&lt;div class=ad&gt;x&lt;/div&gt;<p class=\"k l\">a b  c<!--n--></p><p> </p><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\"></a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"HTTP://X.DE\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\"><a href=\"http://www.y.org\">www.y.org</a></a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b> c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c</p><p> </p><a href=\"http://x.de\">www.y.org</a>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c</p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div>x</div><p>a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color: red\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\" rel=\"nofollow ugc\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c<!--n--></p><p> </p><svg><path></path></svg><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
        "<!DOCTYPE html><html><head></head><body><div class=\"ad\">x</div><p class=\"k l\" last=\"1\">a   c<!--n--></p><a href=\"http://x.de\" onclick=\"e\" style=\"color:red;top:1\">www.y.org</a></body></html>",
    ],
    "edit_reports": [
        "edited <b>; dropped comment; drop <svg>; Unsafe attribute 'onclick' (matched pattern 'on*');", "found-b@39",
    ],
    "relational_edits": [
        "x a b t c", "a b t c", "x", "x t", "x a t c",
    ],
    "sanitized_fragments": [
        "<div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c</p><p> </p><a href=\"http://x.de\">www.y.org</a>", "<p class=\"y\">av</p>",
        "<a href=\"https://a.example/x\">1</a><a>2</a><a href=\"https://a.example/y\">3</a><a>4</a><a href=\"/r\">5</a><a href=\"#f\">6</a>",
        "<img src=\"https://x/y\" srcset=\"https://x/1 1x, /2 2x\"><img><img>", "<a href=\"https://a.example\" rel=\"nofollow noopener\">x</a>", "",
        "&lt;Div  A='1'&gt;x&lt;br/&gt;y&lt;/DIV&gt;&lt;i&gt;z", "<p style=\"color: red\">x</p><p></p>", "<!--c--><p>x</p>",
        "<svg><a href=\"https://a.example\">x</a></svg>y", "<p>y</p>", "<a>1</a><a href=\"https://a.example/x\">2</a>",
        "<a href=\"/go?a=1&amp;to=https%3A%2F%2Fa.example%2F%3Fq%3D1\" class=\"k\">1</a><a href=\"/go?a=1&amp;to=%23f\">2</a><a>3</a>", "<a>1</a>",
        "<a>1</a><a href=\"\u0001https://a.example\">2</a><a href=\"tel:1\">3</a>", "<template><p>t</p></template>",
    ],
    "sanitized_by_edit": [
        "<div class=\"ad\">x</div><p class=\"k l\">a <b>b</b>  c</p><p> </p><a href=\"http://x.de\">www.y.org</a>", "<p class=\"y\">av</p>",
        "<a href=\"https://a.example/x\">1</a><a>2</a><a href=\"https://a.example/y\">3</a><a>4</a><a href=\"/r\">5</a><a href=\"#f\">6</a>",
        "<img src=\"https://x/y\" srcset=\"https://x/1 1x, /2 2x\"><img><img>", "<a href=\"https://a.example\" rel=\"nofollow noopener\">x</a>", "",
        "&lt;Div  A='1'&gt;x&lt;br/&gt;y&lt;/DIV&gt;&lt;i&gt;z", "<p style=\"color: red\">x</p><p></p>", "<!--c--><p>x</p>",
        "<svg><a href=\"https://a.example\">x</a></svg>y", "<p>y</p>", "<a>1</a><a href=\"https://a.example/x\">2</a>",
        "<a href=\"/go?a=1&amp;to=https%3A%2F%2Fa.example%2F%3Fq%3D1\" class=\"k\">1</a><a href=\"/go?a=1&amp;to=%23f\">2</a><a>3</a>", "<a>1</a>",
        "<a>1</a><a href=\"\u0001https://a.example\">2</a><a href=\"tel:1\">3</a>", "<template><p>t</p></template>",
    ],
    "unsafe_handling": [
        "UnsafeHtmlError: Unsafe attribute 'onclick' (matched pattern 'on*')", "UnsafeHtmlError: Unsafe attribute 'onclick' (matched pattern 'on*')",
        "Unsafe attribute 'onclick' (matched pattern 'on*')@1; Unsafe tag 'script' (dropped content)@15; Unsafe tag 'i' (not allowed)@33; Unsafe tag 'svg' (foreign namespace)@41; Unsafe URL in attribute 'href'@52;",
        "Unsafe attribute 'onclick' (matched pattern 'on*')@1; Unsafe tag 'script' (dropped content)@15; Unsafe tag 'i' (not allowed)@33; Unsafe tag 'svg' (foreign namespace)@41; Unsafe URL in attribute 'href'@52;",
    ],
    "sanitized_attributes_as_columns": [
        "<div class=\"ad\"><p class=\"k l\"><a href=\"http://x.de\">", "<p class=\"y\">",
        "<a href=\"https://a.example/x\"><a><a href=\"https://a.example/y\"><a><a href=\"/r\"><a href=\"#f\">",
        "<img src=\"https://x/y\" srcset=\"https://x/1 1x, /2 2x\"><img><img>", "<a href=\"https://a.example\" rel=\"nofollow noopener\">",
    ],
    "links_in_text": [
        "4-22:url:http://a.example/x", "1-20:url:https://a.example/y", "5-21:email:mailto:me@b.example.com", "0-17:url:http://www.c.org/d?e=f#g", "6-11:url:http://d.com",
        "0-16:url://host.example/p", "0-15:url:http://1.2.3.4/", "0-15:url:ftp://x.de:21/y", "0-20:url:http://a.example/(b)", "0-18:url:http://a.example/b",
        "1-18:url:http://q.example/", "", "0-12:email:mailto:a@b.c", "0-23:url:http://xn--bcher-kva.example/\u00fc", "", "", "",
        "0-7:url:http://foo.com 8-15:url:http://bar.com", "", "0-12:url:http://a.b.c.museum", "4-20:url:http://m.example", "0-26:url:https://u:p@h.example:80/p",
        "0-4:url:http://xn--9ca.xn--p1ai", "1-18:url:http://in.example", "", "", "",
    ],
    "links_with_options": [
        "0-9:url:http://1.2.3.4/x", "0-5:url:http://a.xyz 6-13:url:http://b.local 14-19:url:http://c.com",
    ],
    "decoded_bytes_of_all_kinds": [
        "utf-8|\u00e9", "utf-16le|\u00e9", "utf-16be|\u00e9", "iso-8859-2|\u0105", "windows-1252|\u00c1", "windows-1252|\u00e9\u20ac", "windows-1252|\u00e9",
        "utf-8|\u00e9", "windows-1252|\u00e9", "utf-8|\u00e9", "utf-8|\u00e9", "windows-1252|\u00e9", "windows-1252|", "windows-1252|x", "windows-1252|\u201a",
    ],
    "byte_order_marks": [
        "utf-8", "utf-16le", "utf-16be", None, None, None, None, None, None, None, None, None, None, None, None,
    ],
    "files_in_and_out": [
        "windows-1252|a**1**//c**2**",
    ],
    "streamed_windows": [
        "2|6|0", "1|5|0",
    ],
    "functions_in_sql": [
        "a b www.c.org a [b](/x) www.c.org", "html head body p a", "start:p text:a  start:a text:b end:a text: www.c.org", "expected-doctype-but-got-start-tag",
        "http://www.c.org", "<html>\n  <head></head>\n  <body>\n    <p>a <a href=\"/x\">b</a> www.c.org</p>\n  </body>\n</html>",
    ],
    "failures_stay_in_their_row": [
        "x", "StrictModeError: expected-doctype-but-got-start-tag at 1:1", "x", "StrictModeError: expected-doctype-but-got-start-tag at 1:1", "x",
        "StrictModeError: expected-doctype-but-got-start-tag at 1:1", "x", "null",
    ],
    "stored_tables_go_when_told": [
        "1 True",
    ],
    "tree_tables": [
        "<html><head></head><body>x<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table></body></html>",
        "<html><head></head><body><table><caption>c</caption><tbody><tr><th>h</th></tr></tbody></table>y</body></html>",
        "<html><head></head><body><table><colgroup><col span=\"2\"><col></colgroup><tbody><tr><td></td></tr></tbody></table></body></html>",
        "<html><head></head><body><table><tbody><tr><td><table><tbody><tr><td>in</td></tr></tbody></table>out</td></tr></tbody></table></body></html>",
        "<html><head></head><body><p>f</p><table><tbody><tr><td>x</td></tr></tbody></table></body></html>",
        "<html><head></head><body><input type=\"text\"><table><input type=\"hidden\"><tbody><tr></tr></tbody></table></body></html>",
        "<html><head></head><body><table><tbody><tr><td>a</td></tr></tbody><tfoot><tr><td>b</td></tr></tfoot></table></body></html>",
        "<html><head></head><body><table><thead><tr><td>1</td></tr></thead><tbody><tr><td>2</td></tr></tbody></table></body></html>",
        "<html><head></head><body><table> \n <tbody><tr></tr></tbody></table></body></html>",
        "<html><head></head><body><table><form></form><tbody><tr><td>a</td></tr></tbody></table></body></html>",
        "<html><head></head><body><b><table><tbody><tr><td>x</td></tr></tbody></table></b></body></html>",
        "<html><head></head><body><table><tbody><tr><td>k</td></tr></tbody></table></body></html>", "<html><head></head><body>orphan</body></html>",
        "<html><head></head><body>q</body></html>",
    ],
    "tree_select": [
        "<html><head></head><body><select><option>a</option><option selected>b</option></select></body></html>",
        "<html><head></head><body><select><optgroup label=\"x\"><option>1</option></optgroup><optgroup label=\"y\"><option>2</option></optgroup></select></body></html>",
        "<html><head></head><body><select><div>d</div><button><selectedcontent>one</selectedcontent></button><option>one</option></select></body></html>",
        "<html><head></head><body><select><option>a</option><hr><option>b</option></select></body></html>",
        "<html><head></head><body><select></select><p>x</p></body></html>", "<html><head></head><body><select></select><input>after</body></html>",
        "<html><head></head><body><table><tbody><tr><td><select></select></td></tr><tr><td>z</td></tr></tbody></table></body></html>",
        "<html><head></head><body><select></select><textarea>t</textarea></body></html>",
    ],
    "tree_template": [
        "<html><head><template><tr><td>x</td></tr></template></head><body></body></html>",
        "<html><head></head><body><table><template><td>a</td></template></table></body></html>", "<html><head><template><col></template></head><body></body></html>",
        "<html><head><template><div><template>in</template></div>x</template></head><body>y</body></html>", "<html><head><template>h</template></head><body></body></html>",
        "<html><head><template>text</template></head><body></body></html>", "<html><head></head><body><p>x</p></body></html>",
    ],
    "tree_foreign": [
        "<html><head></head><body><svg><foreignObject><p>x<circle></circle></p></foreignObject></svg></body></html>",
        "<html><head></head><body><svg viewBox=\"0 0 1 1\" xlink:href=\"#a\"><linearGradient></linearGradient></svg></body></html>",
        "<html><head></head><body><math><mi>x<mo>+</mo></mi></math></body></html>",
        "<html><head></head><body><math><annotation-xml encoding=\"text/html\"><p>h</p></annotation-xml></math></body></html>",
        "<html><head></head><body><svg></svg><p>out</p></body></html>", "<html><head></head><body><svg><title><b>t</b></title></svg></body></html>",
        "<html><head></head><body><svg>a&lt;b</svg></body></html>", "<html><head></head><body><svg></svg><font color=\"red\">x</font></body></html>",
        "<html><head></head><body><math definitionURL=\"q\"><mtext><b>v</b></mtext></math></body></html>",
        "<html><head></head><body><svg><desc></desc></svg>z</body></html>", "<html><head></head><body><p><svg></svg></p>k</body></html>",
    ],
    "tree_formatting": [
        "<html><head></head><body><b>1<i>2</i></b><i>3</i>4</body></html>", "<html><head></head><body><p><b>x</b></p><b>y</b></body></html>",
        "<html><head></head><body><a>1</a><a>2</a></body></html>", "<html><head></head><body><b><b><b><b>x<p></p></b></b></b></b></body></html>",
        "<html><head></head><body><a><a>x</a><table></table></a></body></html>", "<html><head></head><body><b></b><div><b>1</b>2</div></body></html>",
        "<html><head></head><body><nobr>1</nobr><nobr>2</nobr></body></html>", "<html><head></head><body><i><b>a</b></i><b><p><i>b</i>c</p></b></body></html>",
        "<html><head></head><body><em></em><p><em>1</em>2</p><p>3</p></body></html>", "<html><head></head><body><b>x<object>y</object>z</b></body></html>",
        "<html><head></head><body><font size=\"1\"></font><p><font size=\"1\">a</font>b</p></body></html>", "<html><head></head><body>x</body></html>",
        "<html><head></head><body><b id=\"1\"><b id=\"2\"></b></b><p><b id=\"1\"><b id=\"2\">x</b></b>y</p></body></html>",
    ],
    "tree_frameset": [
        "<html><head></head><frameset><frame></frame><noframes>n</noframes></frameset></html>", "<html><head></head><frameset rows=\"1\"></frameset></html><!--c-->",
        "<html><head></head><body><p>x</p></body></html>", "<html><head></head><frameset><frame></frame></frameset></html>",
        "<html><head></head><frameset></frameset><noframes>k</noframes></html>",
    ],
    "tree_head": [
        "<html><head><title>a&lt;b&gt;c</title></head><body>x</body></html>",
        "<html><head><meta charset=\"utf-8\"><link rel=\"x\"><base href=\"y\"></head><body><p></p></body></html>",
        "<html><head><noscript><link></noscript></head><body><p>in</p></body></html>",
        "<html><head><script>a&lt;b</script><style>p&gt;q</style></head><body>z</body></html>", "<html><head><meta></head><body>m</body></html>",
        "<!DOCTYPE html><!--a--><html lang=\"en\"><!--b--><head><!--c--></head><!--d--><body>e</body><!--f--></html><!--g-->",
        "<html c=\"4\"><head></head><body a=\"1\" b=\"2\">x</body></html>", "<html><head></head><body>x</body></html>", "<html><head></head><body><p></p></body></html>",
        "<html><head></head><body>k</body></html>", "<html><head></head><body> after<p>z</p></body></html>",
        "<html><head><noframes>&lt;b&gt;</noframes></head><body></body></html>",
    ],
    "tree_body_starts": [
        "<html><head></head><body><p>a</p><address>b<p>c</p></address>d</body></html>", "<html><head></head><body><marquee><b>x</b></marquee>y</body></html>",
        "<html><head></head><body><p><img><br><wbr><embed><keygen></keygen><area>x</p></body></html>",
        "<html><head></head><body><button><p>a</p></button><button>b</button></body></html>",
        "<html><head></head><body><ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul></body></html>",
        "<html><head></head><body><dl><dt>a</dt><dd>b</dd><dt>c</dt></dl></body></html>", "<html><head></head><body><form>ab</form>c</body></html>",
        "<html><head></head><body><h1>a</h1><h2>b</h2>c</body></html>", "<html><head></head><body><img src=\"x\"></body></html>",
        "<html><head></head><body><input type=\"text\"><p><input></p></body></html>", "<html><head></head><body><pre>\na</pre><listing>b</listing></body></html>",
        "<html><head></head><body><ruby>a<rb>b</rb><rt>c</rt><rtc>d<rp>e</rp></rtc></ruby></body></html>",
        "<html><head></head><body><textarea>&lt;b&gt;</textarea>c</body></html>",
        "<html><head></head><body><plaintext>a&lt;/plaintext&gt;&lt;b&gt;</plaintext></body></html>", "<html><head></head><body><xmp>&lt;b&gt;</xmp>c</body></html>",
        "<html><head></head><body><iframe>&lt;b&gt;</iframe>c</body></html>", "<html><head></head><body><p>a</p><hr>b</body></html>",
        "<html><head></head><body><video><source><track><param></video></body></html>",
        "<html><head></head><body><optgroup><option>a</option><option>b</option></optgroup></body></html>",
        "<html><head></head><body><p>a<table><tbody><tr><td>b</td></tr></tbody></table>c</p></body></html>", "<html><head></head><body><br>x<div>y</div></body></html>",
        "<html><head></head><body><noembed>&lt;b&gt;</noembed>z</body></html>", "<html><head></head><body>x</body></html>",
        "<html><head></head><body><dialog><details><summary>s</summary></details></dialog></body></html>",
    ],
    "tree_body_ends": [
        "<html><head></head><body><br>x</body></html>", "<html><head></head><body>x</body></html>", "<html><head></head><body><div><span>a</span></div>b</body></html>",
        "<html><head></head><body><li>a</li>b</body></html>", "<html><head></head><body><h1>a</h1>b</body></html>",
        "<html><head></head><body><object><p>a</p></object>b</body></html>", "<html><head></head><body><form><div>ab</div></form>c</body></html>",
        "<html><head></head><body><p>abc</p></body></html>", "<html><head></head><body><div>ab</div></body></html>",
        "<html><head></head><body><dd>a</dd>b<dt>c</dt>d</body></html>", "<html><head></head><body><article><p>a</p></article>b</body></html>",
        "<html><head></head><body><applet><p></p></applet>c</body></html>", "<html><head></head><body><sarcasm>a</sarcasm>b</body></html>",
        "<html><head></head><body><span>a</span>b</body></html>",
    ],
    "tree_namespaces": [
        "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       <svg foreignObject>\n|         <p>\n|           \"x\"\n|           <circle>",
        "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       viewBox=\"0 0 1 1\"\n|       xlink href=\"#a\"\n|       <svg linearGradient>",
        "| <html>\n|   <head>\n|   <body>\n|     <math math>\n|       <math mi>\n|         \"x\"\n|         <mo>\n|           \"+\"",
        "| <html>\n|   <head>\n|   <body>\n|     <math math>\n|       <math annotation-xml>\n|         encoding=\"text/html\"\n|         <p>\n|           \"h\"",
        "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|     <p>\n|       \"out\"",
        "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       <svg title>\n|         <b>\n|           \"t\"",
        "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       \"a<b\"",
        "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|     <font>\n|       color=\"red\"\n|       \"x\"",
        "| <html>\n|   <head>\n|   <body>\n|     <math math>\n|       definitionURL=\"q\"\n|       <math mtext>\n|         <b>\n|           \"v\"",
        "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       <svg desc>\n|     \"z\"", "| <html>\n|   <head>\n|   <body>\n|     <p>\n|       <svg svg>\n|     \"k\"",
    ],
    "tree_fragments": [
        "| \"xy\"", "| <td>\n|   \"a\"\n| <td>\n|   \"b\"", "| <option>\n|   \"a\"\n|   <p>\n|     \"b\"", "| <tr>\n|   <td>\n|     \"x\"", "| \"x\"\n| <tbody>\n|   <tr>",
        "| \"<b>&\"", "| \"<b>&amp;\"", "| <col>", "| \"k\"", "| <svg title>\n|   \"t\"\n| <svg circle>", "| <html>\n|   <head>\n|   <body>\n|     <p>\n|       \"x\"",
    ],
    "quirks_modes": [
        "no-quirks", "quirks", "quirks", "limited-quirks", "quirks", "no-quirks", "quirks",
    ],
    "lexer_tokens": [
        "t(a) s(b c=1 d=2 e=3 f= g=h) t(x) e(b)", "s(a/) s(b/) s(c x=1/)", "c(a) c() c() t( ) c() c(a) t(b) c(c)", "d(html) d(xp|s) d(ys)", "d(a) d(bp) d(c) d(d)",
        "c(?php x) c(x) c( y) t(<3<)", "s(title) t(a<) e(title) s(b)", "s(script) t(<!--<script></script>-->) e(script) t(x)", "s(style) t(</styl) e(style)",
        "s(textarea) t(</text>) e(textarea)", "s(plaintext) t(</plaintext>)", "t(&<\u00acit;AB\ufffd\u20ac\u00a0\u00a9=1)", "s(a b=&<x&notit; c=&copy=1 d=A)",
        "s(a a=1 b=)", "s(a b=c)", "s(a =b= c\"d=)", "s(a b=c\"d e=`f)", "t(x\ny\nz)", "c([CDATA[x]])", "", "t(<a)", "e(a)", "s(svg) c([CDATA[y]]) e(svg)",
        "s(xmp) t(</x>) e(xmp) s(noembed) t(</no) e(noembed) s(noframes) t(<b>) e(noframes) s(iframe) t(</if>) e(iframe)", "s(script) t(a<!-- b) e(script) t(c)",
        "s(script) t(<!--<script>x</script>y) e(script) t(z)", "s(script) t(<!-- - -- -->) e(script)",
    ],
    "lexer_states": [
        "t(a<b>&) e(title) t(x)", "t(a<b>&amp;) e(style) t(x)", "t(<!--<script></script>-->) e(script) t(x)", "t(a</plaintext>&amp;)", "t(a<b>) s(c)",
        "t(</titles>) e(title)",
    ],
    "xml_coercion": [
        "<html><head></head><body>a b\ufffd\ufffd\ufffd\ufffdf\ufffd</body></html>", "<!--a- -b- - -c--><html><head></head><body></body></html>",
        "a b\ufffd\ufffd\ufffd\ufffdf\ufffd", "a- -b- - -c",
    ],
    "error_codes": [
        "unknown-doctype@1:1 missing-quote-before-doctype-public-identifier@1:22",
        "unknown-doctype@1:1 missing-whitespace-before-doctype-public-identifier@1:22 eof-in-doctype-public-identifier@1:24",
        "unknown-doctype@1:1 missing-whitespace-between-doctype-public-and-system-identifiers@1:26", "unknown-doctype@1:1 missing-doctype-public-identifier@1:22",
        "unknown-doctype@1:1 missing-doctype-public-identifier@1:23", "unknown-doctype@1:1 unexpected-character-after-doctype-public-keyword@1:22",
        "unknown-doctype@1:1 missing-quote-before-doctype-public-identifier@1:23", "unknown-doctype@1:1 missing-doctype-public-identifier@1:23",
        "unknown-doctype@1:1 abrupt-doctype-public-identifier@1:25", "unknown-doctype@1:1 missing-whitespace-between-doctype-public-and-system-identifiers@1:26",
        "unknown-doctype@1:1 unexpected-character-after-doctype-public-identifier@1:26", "unknown-doctype@1:1 missing-quote-before-doctype-system-identifier@1:27",
        "unknown-doctype@1:1 missing-quote-before-doctype-system-identifier@1:27", "unknown-doctype@1:1 abrupt-doctype-system-identifier@1:29",
        "unknown-doctype@1:1 missing-quote-before-doctype-system-identifier@1:22", "unknown-doctype@1:1 missing-whitespace-after-doctype-public-identifier@1:22",
        "unknown-doctype@1:1 missing-doctype-system-identifier@1:22", "unknown-doctype@1:1 unexpected-character-after-doctype-system-keyword@1:22",
        "unknown-doctype@1:1 missing-quote-before-doctype-system-identifier@1:23", "unknown-doctype@1:1 missing-doctype-system-identifier@1:23",
        "unknown-doctype@1:1 eof-in-doctype-system-identifier@1:25", "unknown-doctype@1:1 unexpected-character-after-doctype-system-identifier@1:26",
        "unknown-doctype@1:1 missing-whitespace-after-doctype-name@1:16", "unknown-doctype@1:1 expected-doctype-name-but-got-right-bracket@1:10",
        "missing-whitespace-before-doctype-name@1:10", "unknown-doctype@1:1 eof-in-doctype@1:10", "abrupt-closing-of-empty-comment@1:20", "incorrectly-closed-comment@1:21",
        "eof-in-comment@1:21", "incorrectly-opened-comment@1:18", "empty-end-tag@1:18",
        "duplicate-attribute@1:21 missing-attribute-value@1:25 expected-closing-tag-but-got-eof@1:26",
        "unexpected-character-after-solidus-in-tag@1:19 missing-whitespace-between-attributes@1:26 expected-closing-tag-but-got-eof@1:32",
        "unexpected-character-in-unquoted-attribute-value@1:24 unexpected-equals-sign-before-attribute-name@1:25 unexpected-character-in-attribute-name@1:28 expected-closing-tag-but-got-eof@1:32",
        "unexpected-question-mark-instead-of-tag-name@1:17", "invalid-first-character-of-tag-name@1:18 invalid-first-character-of-tag-name@1:21",
        "eof-before-tag-name@1:17",
        "control-character-reference@1:16 control-character-reference@1:20 noncharacter-character-reference@1:26 missing-semicolon-after-character-reference@1:34 missing-semicolon-after-character-reference@1:40",
        "invalid-codepoint-before-head@1:16 unexpected-null-character@1:17 noncharacter-in-input-stream@1:19",
        "unexpected-null-character@1:21 invalid-codepoint-in-foreign-content@1:21 invalid-codepoint-in-foreign-content@1:21 unexpected-null-character@1:22",
        "unexpected-null-character@1:22 invalid-codepoint-before-head@1:22", "unexpected-hidden-input-after-head@1:29",
        "unexpected-characters-in-template-column-group@1:31", "unexpected-characters-in-column-group@1:33 foster-parenting-character@1:34",
        "expected-doctype-but-got-chars@1:1", "expected-doctype-but-got-end-tag@1:1 unexpected-end-tag-before-html@1:1", "expected-doctype-but-got-start-tag@1:1",
        "unexpected-end-tag@1:19", "foster-parenting-character@1:24 foster-parenting-start-tag@1:24", "adoption-agency-1.3@1:22",
        "image-start-tag@1:22 expected-closing-tag-but-got-eof@1:29", "foster-parenting-start-tag@1:27", "unexpected-select-in-select@1:24",
        "unexpected-char-after-body@1:29", "unexpected-token-in-frameset@1:26 unexpected-token-after-frameset@1:38",
        "eof-in-script-html-comment-like-text@1:28 expected-named-closing-tag-but-got-eof@1:28", "expected-named-closing-tag-but-got-eof@1:24",
        "unexpected-html-element-in-foreign-content@1:21 unexpected-end-tag@1:24", "cdata-in-html-content@1:18", "unexpected-end-tag@3:1", "unexpected-doctype@1:19",
        "unexpected-start-tag@1:20 expected-closing-tag-but-got-eof@1:24", "unexpected-start-tag-implies-end-tag@1:19 expected-closing-tag-but-got-eof@1:22",
        "unexpected-end-tag@1:20",
    ],
    "error_messages": [
        "Expected DOCTYPE but got </p> tag", "Unexpected </div> end tag", "Misnested tags require adoption agency algorithm", "Duplicate attribute name",
        "Start tag in table requires foster parenting",
    ],
    "error_highlights": [
        "<p></div><b>|4|10", "  <a b b>x|3|10",
    ],
    "strict_mode": [
        "x", "StrictModeError: expected-doctype-but-got-start-tag at 1:1", "StrictModeError: duplicate-attribute at 1:21",
    ],
    "html_compact": [
        "<html><head></head><body><div><p>a</p><p>b</p></div></body></html>", "<html><head></head><body><div> <b>x</b> <i>y</i> </div></body></html>",
        "<html><head></head><body><ul><li>a</li><li><b>b</b> c</li></ul></body></html>", "<html><head></head><body><p>a  b\n c <b> d</b></p></body></html>",
        "<html><head></head><body><pre> a\n  b</pre><textarea> x</textarea></body></html>", "<html><head></head><body><div>text<p>block</p>tail</div></body></html>",
        "<html><head></head><body><div><!--c--><span>s</span></div></body></html>",
        "<html><head></head><body><table><tbody><tr><td>1</td><td>2</td></tr></tbody></table></body></html>",
        "<html><head></head><body><a href='x\"y' title=\"q'r\" id disabled class data-x=\"a&amp;b<c>\">l</a></body></html>",
        "<html><head></head><body><p>&lt;&amp;&gt;\u00a0\"'</p></body></html>", "<html><head></head><body><br><img src=\"x\"><input></body></html>",
        "<html><head><template><p>t</p></template></head><body></body></html>", "<html><head><script>a&lt;b &amp;&amp; c</script></head><body></body></html>",
        "<html><head></head><body><span>a</span><span>b</span></body></html>", "<html><head></head><body><div>\n<span>a</span>\n<span>b</span>\n</div></body></html>",
        "<html><head></head><body><svg><path d=\"m\"></path></svg></body></html>", "<!DOCTYPE html><!--c--><html><head><title>t</title></head><body></body></html>",
        "<html><head></head><body><div><a>x</a><a>y</a></div></body></html>", "<html><head></head><body><blockquote><h1>t</h1><p>u</p></blockquote></body></html>",
    ],
    "html_pretty": [
        "<html>\n  <head></head>\n  <body>\n    <div>\n      <p>a</p>\n      <p>b</p>\n    </div>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <div>\n      <b>x</b>\n      <i>y</i>\n    </div>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <ul>\n      <li>a</li>\n      <li><b>b</b> c</li>\n    </ul>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <p>a  b c <b>d</b></p>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <pre> a\n  b</pre>\n    <textarea> x</textarea>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <div>\n      text\n      <p>block</p>\n      tail\n    </div>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <div><!--c--><span>s</span></div>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <table>\n      <tbody>\n        <tr>\n          <td>1</td>\n          <td>2</td>\n        </tr>\n      </tbody>\n    </table>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <a href='x\"y' title=\"q'r\" id disabled class data-x=\"a&amp;b<c>\">l</a>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <p>&lt;&amp;&gt; \"'</p>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <br>\n    <img src=\"x\">\n    <input>\n  </body>\n</html>",
        "<html>\n  <head>\n    <template>\n      <p>t</p>\n    </template>\n  </head>\n  <body></body>\n</html>",
        "<html>\n  <head>\n    <script>a&lt;b &amp;&amp; c</script>\n  </head>\n  <body></body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <span>a</span>\n    <span>b</span>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <div>\n      <span>a</span>\n      <span>b</span>\n    </div>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <svg><path d=\"m\"></path></svg>\n  </body>\n</html>",
        "<!DOCTYPE html>\n<!--c-->\n<html>\n  <head>\n    <title>t</title>\n  </head>\n  <body></body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <div>\n      <a>x</a>\n      <a>y</a>\n    </div>\n  </body>\n</html>",
        "<html>\n  <head></head>\n  <body>\n    <blockquote>\n      <h1>t</h1>\n      <p>u</p>\n    </blockquote>\n  </body>\n</html>",
    ],
    "html_deep": [
        "10004 18069045",
    ],
    "plain_text": [
        "a b", "x y", "a b c", "a  b\n c d", "a\n  b x", "text block tail", "s", "1 2", "l", "<&>\u00a0\"'", "", "t", "a<b && c", "a b", "a b", "", "t", "x y", "t u",
        "a|b", " a |b", "in out", "u",
    ],
    "markdown": [
        "# a\n\n### b *c*\n\nd", "- a\n- b\n\n  - c", "1. x\n2. y\n\nz", "a **b** *c* ``d`e``", "[l](<http://x.de/a%20b>) [m] [n **o**](/y)", "```\nx\n y\n```",
        "> a\n>\n> b\n\nc", "a\nb\n\n---\n\nc", "<img src=\"x\" alt=\"y\">", "<table><tbody><tr><td>1</td></tr></tbody></table>", "\\*a\\* \\_b\\_ \\[c\\] \\`d\\` \\\\e",
        "a\n\nb\n\nc\n\nd", "-\n\na\n\n\n-\n\n```\nb\n```", "``` `` ````a`", "x", "> - q",
    ],
    "markdown_columns": [
        "``a`b`` a\\`b", "``` `` ``` \\`\\`", "`x` x", "`*_[]\\` \\*\\_\\[\\]\\\\",
    ],
    "tag_columns": [
        "<a href='x\"y' id=\"b\" class=\"A b\" onclick=\"z\">", "<a href='x\"y' id=\"c\" class=\"A b\" onclick=\"z\">",
        "<a href='x\"y' id=\"b\" class=\"A b\" onclick=\"z\" new>", "<a href='x\"y' id=\"b\">", "<a href='x\"y' id=\"b\">", "a b nofollow",
    ],
    "selectors_on_rows": [
        "p p p p p", "html head body div p p span p b ul li li li li a section p em template p", "div", "p li p", "div", "p", "p", "p", "p", "a", "a", "a", "p p",
        "p p p li li li li p p", "p p p", "p", "", "b", "p p p", "p p p", "em", "li li", "li li", "li li", "p", "li li li",
        "html head body div span b ul a section em template", "head span em template", "html p", "", "", "li li li li", "p",
    ],
    "selectors_by_joins": [
        "p p p", "p p p", "p", "p p", "a", "a", "b", "a p", "a", "div section template", "li", "b", "p", "div", "li li li",
    ],
    "selectors_in_worker": [
        "p p p p p", "html head body div p p span p b ul li li li li a section p em template p", "div", "p li p", "div", "p", "p", "p", "p", "a", "a", "a", "p p",
        "p p p li li li li p p", "p p p", "p", "", "b", "p p p", "p p p", "em", "li li", "li li", "li li", "p", "li li li",
        "html head body div span b ul a section em template", "head span em template", "html p", "", "", "li li li li", "p", "p p p", "p p p", "p", "p p", "a", "a", "b",
        "a p", "a", "div section template", "li", "b", "p", "div", "li li li",
    ],
    "selector_errors": [
        "SelectorError", "SelectorError", "SelectorError", "SelectorError", "SelectorError", "ValueError", "fine",
    ],
}
