"""Grammars of the supported languages and dialects. Identifiers are n, numbers 0, strings a double quote."""

from __future__ import annotations

PYTHON_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PYTHON_SOFT = {"match", "case", "type", "_"}
PYTHON = """
stmts_ = stmt*
stmt = simple 'NL' | compound
simple = small semi* ';'?
semi = ';' small
small = 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' | 'raise' expr | 'raise' expr 'from' expr | 'global' names | 'nonlocal' names | 'del' dels | 'assert' expr | 'assert' expr ',' expr | 'import' modules | 'from' source 'import' imported | 'type' NAME tparams? '=' expr | stars | assign | yield
assign = left+ value | target aug value | target ':' expr | target ':' expr '=' value
left = targets '='
value = stars | yield
aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
yield = 'yield' stars? | 'yield' 'from' expr
names = NAME | NAME ',' names
dels = target | target ',' | target ',' dels
modules = module | module ',' modules
module = dotted | dotted 'as' NAME
dotted = NAME | NAME '.' dotted
source = dots* dotted | dots+
dots = '.' | '...'
imported = '*' | ones | (import)
ones = one | one ',' ones
one = NAME | NAME 'as' NAME
import = one | one ',' | one ',' import
targets = target | '*' target | target ',' targets? | '*' target ',' targets?
target = NAME | (targets) | (none) | [targets] | [none] | prim post* '.' NAME | prim post* [slices]
none = ε
suite = 'NL' »stmts_« | simple 'NL'
compound = if | 'while' named ':' suite else? | for | 'async' for | 'try' ':' suite handler+ else? finally? | 'try' ':' suite star+ else? finally? | 'try' ':' suite finally | with | 'async' with | deco* def | deco* 'async' def | deco* class | match
if = 'if' named ':' suite elif* else?
elif = 'elif' named ':' suite
else = 'else' ':' suite
for = 'for' targets 'in' stars ':' suite else?
handler = 'except' ':' suite | 'except' expr ':' suite | 'except' expr 'as' NAME ':' suite
star = 'except' '*' expr ':' suite | 'except' '*' expr 'as' NAME ':' suite
finally = 'finally' ':' suite
with = 'with' items ':' suite | 'with' (witems) ':' suite
items = item | item ',' items
item = expr | expr 'as' target | expr 'as' '*' target
witems = item | item ',' | item ',' witems
deco = '@' named 'NL'
def = 'def' NAME tparams? (params) ':' suite | 'def' NAME tparams? (params) '->' expr ':' suite
class = 'class' NAME tparams? ':' suite | 'class' NAME tparams? (args) ':' suite
tparams = [tplist]
tplist = tparam | tparam ',' | tparam ',' tplist
tparam = NAME bound? | '*' NAME | '**' NAME
bound = ':' expr
params = ε | plist
plist = param | param ',' | param ',' plist
param = NAME note? default? | '/' | '*' | '*' NAME note? | '*' NAME ':' '*' expr | '**' NAME note?
note = ':' expr
default = '=' expr
match = 'match' subject ':' 'NL' »cases«
subject = named | starred ',' stars? | named ',' stars?
cases = case+
case = 'case' patterns ':' suite | 'case' patterns 'if' named ':' suite
patterns = pattern | pattern ',' | pattern ',' patterns
pattern = alternatives | alternatives 'as' NAME | '*' NAME
alternatives = ppat | ppat '|' alternatives
ppat = dotted | dotted (pargs) | literal | [pats] | (pats) | {pmap}
pats = ε | patterns
pargs = ε | parglist
parglist = parg | parg ',' | parg ',' parglist
parg = pattern | NAME '=' pattern
pmap = ε | pmlist
pmlist = pm | pm ',' | pm ',' pmlist
pm = key ':' pattern | '**' NAME
key = literal | dotted
literal = '-'? 'NUM' | '-'? 'NUM' sign 'NUM' | 'STR'+ | 'None' | 'True' | 'False'
sign = '+' | '-'
stars = starred | starred ',' | starred ',' stars
starred = expr | '*' operand binary*
named = expr | NAME ':=' expr
expr = or | or 'if' or 'else' expr | 'lambda' ':' expr | 'lambda' lparams ':' expr
lparams = lparam | lparam ',' | lparam ',' lparams
lparam = NAME default? | '/' | '*' | '*' NAME | '**' NAME
or = operand binary*
binary = binop operand
operand = pre* prim post*
pre = 'not' | '-' | '+' | '~' | 'await'
binop = 'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
prim = NAME | 'NUM' | 'STR'+ | '...' | 'None' | 'True' | 'False' | (paren) | [list] | {braces}
post = '.' NAME | (args) | [slices]
paren = ε | yield | nameds | named comp
list = ε | nameds | named comp
nameds = element | element ',' | element ',' nameds
element = named | '*' operand binary*
braces = ε | nameds | named comp | pairs | expr ':' expr comp
pairs = pair | pair ',' | pair ',' pairs
pair = expr ':' expr | '**' operand binary*
comp = 'for' targets 'in' or more* | 'async' 'for' targets 'in' or more*
more = 'for' targets 'in' or | 'async' 'for' targets 'in' or | 'if' cond
cond = or | NAME ':=' expr | 'lambda' ':' expr
args = ε | arglist | named comp
arglist = arg | arg ',' | arg ',' arglist
arg = named | NAME '=' expr | '*' expr | '**' expr
slices = slice | slice ',' | slice ',' slices
slice = named | '*' operand binary* | expr? ':' expr? | expr? ':' expr? ':' expr?
field = stars | stars '=' | yield | NAME ':=' expr
"""

JS_WORDS = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
JS_SOFT = {"async", "await", "let", "static", "of", "get", "set", "as", "from", "yield"}
TS_SOFT = JS_SOFT | {"type", "interface", "enum", "namespace", "module", "declare", "abstract", "implements", "private", "public", "protected", "readonly", "override", "keyof", "unique", "infer", "is", "asserts", "satisfies", "require", "accessor", "out", "global"}
_SCRIPT = """
items_ = item*
stmts_ = stmt*
eos = ';' | EOS
item = stmt | 'import' clause 'from' 'STR' with? eos | 'import' 'STR' with? eos | export
with = 'with' {object}
clause = NAME | NAME ',' named | named
named = '*' 'as' NAME | {specs}
specs = ε | speclist
speclist = spec | spec ',' | spec ',' speclist
spec = WORD | WORD 'as' WORD | 'STR' 'as' WORD | WORD 'as' 'STR' | TYPESPEC
export = 'export' {specs} eos | 'export' {specs} 'from' 'STR' with? eos | 'export' '*' 'from' 'STR' eos | 'export' '*' 'as' WORD 'from' 'STR' eos | 'export' decl | 'export' 'default' func | 'export' 'default' class | 'export' 'default' asg eos
decl = func | class | var eos DECLS
stmt = {stmts_} | decl | ';' | plain eos | 'if' (expr) stmt | 'if' (expr) stmt 'else' stmt | 'for' (for) stmt | 'for' 'await' (for) stmt | 'while' (expr) stmt | 'do' stmt 'while' (expr) ';'? | 'try' {stmts_} catch | 'try' {stmts_} catch? 'finally' {stmts_} | 'return' expr? eos | 'throw' expr eos | 'break' NAME? eos | 'continue' NAME? eos | 'debugger' eos | 'switch' (expr) {cases} | 'with' (expr) stmt | NAME ':' stmt
catch = 'catch' {stmts_} | 'catch' (catch1) {stmts_}
catch1 = pattern note?
cases = clause1*
clause1 = 'case' expr ':' stmts_ | 'default' ':' stmts_
for = forinit? ';' expr? ';' expr? | varword pattern note? forword expr | lhs forword expr
forword = 'in' | 'of'
forinit = expr | var
var = varword bindings
varword = 'const' | 'let' | 'var' USING
bindings = binding | binding ',' bindings
binding = pattern DEFINITE note? init?
init = '=' asg
note = NOTE
func = 'async'? 'function' '*'? NAME? generics? (params) result? body
body = {stmts_} BODYLESS
generics = GENERICS
result = RESULT
params = ε | plist
plist = param | param ',' | '...' pattern note? | param ',' plist
param = MODS pattern OPT note? init? THISPARAM
pattern = NAME | [apat] | {opat}
apat = aelem | aelem ',' apat
aelem = ε | pattern init? | '...' pattern
opat = ε | oplist
oplist = oprop | oprop ',' | oprop ',' oplist
oprop = NAME init? | propname ':' pattern init? | '...' pattern
propname = WORD | 'STR' | 'NUM' | [asg]
class = DECORATED 'class' NAME? generics? heritage? IMPLEMENTS {members_}
heritage = 'extends' prim post* TARGS
members_ = member*
member = ';' | mods method | mods field eos | 'static' {stmts_} MEMBERS
method = methodmods mname OPT generics? (params) result? body
methodmods = ε | 'async' | '*' | 'async' '*' | 'get' | 'set'
mods = MEMBERMODS
mname = propname | 'PRIVATE'
field = mname OPT DEFINITE note? init?
object = ε | olist
olist = prop | prop ',' | prop ',' olist
prop = NAME | NAME '=' asg | propname ':' asg | '...' asg | methodmods mname generics? (params) result? {stmts_}
expr = asg comma*
comma = ',' asg
plain = start btail comma* | slhs aop asg comma* | arrow comma* | yield comma*
asg = operand btail | lhs aop asg | arrow | yield
yield = 'yield' asg? | 'yield' '*' asg
arrow = NAME '=>' abody | 'async' NAME '=>' abody | generics? (params) result? '=>' abody | 'async' generics? (params) result? '=>' abody
abody = {stmts_} | abody1
abody1 = start btail | slhs aop asg | arrow
btail = ε | binop operand btail | '?' asg ':' asg CAST
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof'
start = pre operand | sprim post*
slhs = NAME | [elems] | (expr) | sprim post* access
operand = pre operand | prim post* | 'PRIVATE' 'in' operand
lhs = NAME | [elems] | {object} | (expr) | prim post* access
access = '.' WORD | '.' 'PRIVATE' | [expr] ASSERTED
pre = 'new' | '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ASSERTION
sprim = NAME | 'NUM' | 'STR' | 'RE' | 'this' | 'null' | 'true' | 'false' | 'super' | (expr) | [elems] | 'new' '.' NAME | 'import' (args) | 'import' '.' NAME | func
prim = sprim | {object} | class
elems = elem | elem ',' elems
elem = ε | asg | '...' asg
post = access | '?.' WORD | '?.' 'PRIVATE' | '?.' (args) | '?.' [expr] | (args) | 'STR' | '++' | '--' TARGPOST
args = ε | arglist
arglist = arg | arg ',' | arg ',' arglist
arg = asg | '...' asg
"""
_PLAIN = {"THISPARAM": "", "NOTE": "'NEVER'", "RESULT": "'NEVER'", "GENERICS": "'NEVER'", "MODS": "", "OPT": "", "DEFINITE": "", "IMPLEMENTS": "", "TARGS": "", "DECORATED": "", "MEMBERMODS": "ε | 'static'", "USING": "", "TYPESPEC": "'NEVER'", "DECLS": "", "BODYLESS": "", "MEMBERS": "", "CAST": "", "ASSERTED": "", "ASSERTION": "", "TARGPOST": ""}
_TYPED = {
    "THISPARAM": "| 'this' note", "NOTE": "':' type | ':' predicate", "RESULT": "':' type | ':' predicate", "GENERICS": "'<' tparams '>'", "MODS": "deco* pmod*", "OPT": "'?'?", "DEFINITE": "'!'?", "IMPLEMENTS": "impl?", "TARGS": "targs?", "DECORATED": "deco* 'abstract'?", "USING": "",
    "MEMBERMODS": "deco* pmod*", "TYPESPEC": "'type' WORD | 'type' WORD 'as' WORD", "BODYLESS": "| eos", "ASSERTED": "| '!'", "ASSERTION": "| targs", "TARGPOST": "| targs", "CAST": "| 'as' type btail | 'as' 'const' btail | 'satisfies' type btail",
    "MEMBERS": "| mods [indexed] note? eos",
    "DECLS": "| 'interface' NAME generics? ext? {tmembers_} | 'type' NAME generics? '=' type eos | 'const'? 'enum' NAME {enums} | 'declare' decl | 'namespace' dotted {items_} | 'module' dotted {items_} | 'module' 'STR' {items_} | 'global' {items_} | 'export' decl | 'import' NAME '=' asg eos | 'import' 'type' clause 'from' 'STR' eos | 'export' 'type' {specs} eos | 'export' '=' asg eos",
}
_TYPES = """
deco = '@' NAME access* dargs?
dargs = (args)
pmod = 'static' | 'private' | 'public' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor'
impl = 'implements' typelist
ext = 'extends' typelist
typelist = type | type ',' typelist
tparams = tparam | tparam ',' | tparam ',' tparams
tparam = tpmod* NAME tpext? tpdef?
tpmod = 'const' | 'in' | 'out'
tpext = 'extends' type
tpdef = '=' type
targs = '<' typelist '>'
predicate = 'asserts' NAME | 'asserts' NAME 'is' type | NAME 'is' type | 'this' 'is' type
type = union | union 'extends' union '?' type ':' type | generics? (params) '=>' type | generics? (params) '=>' predicate | 'new' generics? (params) '=>' type | 'abstract' 'new' generics? (params) '=>' type
union = bar? ptype uni*
bar = '|' | '&'
uni = '|' ptype | '&' ptype
ptype = tprim tpost* | topr ptype
topr = 'keyof' | 'readonly' | 'unique' | 'infer'
tprim = dotted targs? | 'STR' | 'NUM' | '-' 'NUM' | 'this' | 'void' | 'null' | 'true' | 'false' | {tmembers_} | {mapped} | [tuple] | (type) | 'typeof' dotted targs? | 'import' (args) timp*
timp = '.' NAME targs?
dotted = NAME | NAME '.' dotted
tpost = [none] | [type]
none = ε
tuple = ε | tuples
tuples = tup | tup ',' | tup ',' tuples
tup = '...'? type '?'? | '...'? NAME '?'? ':' type
mapped = mapsign? [mapkey] mapopt? ':' type ';'?
mapsign = 'readonly' | '-' 'readonly' | '+' 'readonly'
mapopt = '?' | '-' '?' | '+' '?'
mapkey = NAME 'in' type | NAME 'in' type 'as' type
indexed = NAME ':' type
tmembers_ = tmember*
tmember = tfield sep
sep = ';' | ',' | EOS
tfield = pmod* propname '?'? note? | pmod* propname '?'? generics? (params) result? | generics? (params) result? | 'new' generics? (params) result? | pmod* [indexed] note | 'get' propname (params) result? | 'set' propname (params)
enums = ε | enumlist
enumlist = enum | enum ',' | enum ',' enumlist
enum = propname init?
"""


def _filled(parts: dict[str, str]) -> str:
    out = _SCRIPT
    for name in sorted(parts, key=len, reverse=True):
        out = __import__("re").sub(rf"(?<![\w']){name}(?![\w'])", parts[name].replace("\\", r"\\"), out)
    return out


JAVASCRIPT = _filled(_PLAIN)
TYPESCRIPT = _filled(_TYPED) + _TYPES

JAVA_WORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
JAVA_SOFT = {"record", "var", "yield", "sealed", "permits", "non", "module", "open", "requires", "exports", "when", "with"}
JAVA = """
unit = package? imports* types_
package = anno* 'package' dotted ';'
imports = 'import' 'static'? dotted ';' | 'import' 'static'? dotted '.' '*' ';' | ';'
dotted = NAME | NAME '.' dotted
types_ = typedecl*
typedecl = class | ';'
mod = anno | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
anno = '@' dotted | '@' dotted (annoargs)
annoargs = ε | annovalue | annopairs
annopairs = annopair | annopair ',' annopairs
annopair = NAME '=' annovalue
annovalue = ternary | anno | {annovalues}
annovalues = ε | annovaluelist
annovaluelist = annovalue | annovalue ',' | annovalue ',' annovaluelist
class = mod* 'class' NAME generics? ext? impl? permits? {members_} | mod* 'interface' NAME generics? exts? permits? {members_} | mod* 'enum' NAME impl? {enum} | mod* 'record' NAME generics? (params) impl? {members_} | mod* '@' 'interface' NAME {members_}
ext = 'extends' type
exts = 'extends' typelist
impl = 'implements' typelist
permits = 'permits' typelist
typelist = type | type ',' typelist
generics = '<' tparams '>'
tparams = tparam | tparam ',' tparams
tparam = anno* NAME | anno* NAME 'extends' bounds
bounds = type | type '&' bounds
type = anno* basic dims | anno* named dims
basic = 'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double'
named = NAME targs? | NAME targs? '.' anno* named
targs = '<' '>' | '<' targlist '>'
targlist = targ | targ ',' targlist
targ = type | anno* '?' | anno* '?' 'extends' type | anno* '?' 'super' type
dims = ε | [none] dims
none = ε
enum = ε | enumbody | enumbody ';' members_ | ';' members_
enumbody = constant | constant ',' | constant ',' enumbody
constant = anno* NAME | anno* NAME (args) | anno* NAME {members_} | anno* NAME (args) {members_}
members_ = member*
member = ';' | class | {stmts_} | 'static' {stmts_} | mod* type vars ';' | mod* generics? type NAME (params) dims throws? mbody | mod* generics? 'void' NAME (params) throws? mbody | mod* generics? NAME (params) throws? {stmts_} | mod* NAME {stmts_}
mbody = {stmts_} | ';' | 'default' annovalue ';'
throws = 'throws' typelist
vars = var | var ',' vars
var = NAME dims | NAME dims '=' init
init = expr | {inits}
inits = ε | ',' | initlist
initlist = init | init ',' | init ',' initlist
params = ε | plist
plist = param | param ',' plist
param = mod* type NAME dims | mod* type anno* '...' NAME | mod* type 'this' | mod* type NAME '.' 'this'
stmts_ = bstmt*
bstmt = mod* localtype vars ';' | class | stmt
localtype = type | 'var'
stmt = {stmts_} | ';' | sexpr ';' | 'if' (expr) stmt | 'if' (expr) stmt 'else' stmt | 'while' (expr) stmt | 'do' stmt 'while' (expr) ';' | 'for' (for) stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'yield' expr ';' | 'switch' (expr) {switch} | 'synchronized' (expr) {stmts_} | try | 'assert' expr ';' | 'assert' expr ':' expr ';' | NAME ':' stmt
sexpr = lhs aop expr | '++' operand | '--' operand | lhs '++' | lhs '--' | prim post* call | 'new' creator post*
call = (args) | '.' targs? NAME (args)
try = 'try' {stmts_} catch+ | 'try' {stmts_} catch* 'finally' {stmts_} | 'try' (resources) {stmts_} catch* finally?
finally = 'finally' {stmts_}
catch = 'catch' (caught) {stmts_}
caught = mod* union NAME
union = type | type '|' union
resources = resource | resource ';' | resource ';' resources
resource = mod* localtype NAME '=' expr | prim post*
for = forinit? ';' expr? ';' fors? | mod* localtype NAME dims ':' expr
forinit = mod* localtype vars | fors
fors = sexpr | sexpr ',' fors
switch = group* | rule*
group = label+ bstmt*
label = 'case' caselist ':' | 'default' ':'
rule = 'case' caselist '->' rbody | 'default' '->' rbody
rbody = expr ';' | {stmts_} | 'throw' expr ';'
caselist = casepat | casepat ',' caselist
casepat = ternary | 'default' | pat | pat 'when' expr
pat = mod* localtype NAME | type (pats)
pats = ε | patlist
patlist = pat | pat ',' patlist
expr = ternary | lhs aop expr | lambda
lambda = NAME '->' lbody | (lparams) '->' lbody
lparams = ε | names | plist | vplist
names = NAME | NAME ',' names
vplist = 'var' NAME | 'var' NAME ',' vplist
lbody = expr | {stmts_}
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
ternary = or | or '?' expr ':' ternary | or '?' expr ':' lambda
or = operand binary*
binary = binop operand | 'instanceof' 'final'? type | 'instanceof' pat
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>'
operand = '!' operand | '~' operand | '+' operand | '-' operand | '++' operand | '--' operand | (cast) operand | (cast) lambda | prim post* | prim post* '++' | prim post* '--'
cast = type | type '&' bounds
lhs = NAME | (expr) | prim post* '.' NAME | prim post* [expr]
prim = NAME | 'NUM' | 'STR' | 'CHR' | 'true' | 'false' | 'null' | 'this' | 'super' | (expr) | 'new' creator | basic dims '.' 'class' | 'void' '.' 'class' | type '::' ref | 'switch' (expr) {switch}
creator = anno* named (args) | anno* named (args) {members_} | anno* named indexes dims | anno* basic indexes dims | anno* named [none] dims {inits} | anno* basic [none] dims {inits}
indexes = [expr] | [expr] indexes
ref = targs? NAME | 'new'
post = '.' targs? NAME | '.' 'this' | '.' 'class' | '.' 'super' | '.' 'new' creator | [expr] | (args) | '::' ref | [none] dims '.' 'class'
args = ε | arglist
arglist = expr | expr ',' arglist
"""

GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
GO = """
unit = 'package' NAME ';' imports* decls_
imports = 'import' import ';' | 'import' (importlist) ';'
import = 'STR' | NAME 'STR' | '.' 'STR'
importlist = ε | import ';'? | import ';' importlist
decls_ = topdecl*
topdecl = decl ';' | func ';'
decl = 'const' const | 'const' (consts) | 'var' var | 'var' (vars) | 'type' typespec | 'type' (typespecs)
consts = ε | const ';'? | const ';' consts
const = names | names '=' exprs | names type '=' exprs
vars = ε | var ';'? | var ';' vars
var = names type | names type '=' exprs | names '=' exprs
typespecs = ε | typespec ';'? | typespec ';' typespecs
typespec = NAME tparams? '='? type
tparams = [tplist]
tplist = tparam | tparam ',' | tparam ',' tplist
tparam = names constraint
constraint = cterm | cterm '|' constraint
cterm = '~'? type
names = NAME | NAME ',' names
func = 'func' NAME tparams? signature body? | 'func' (params) NAME signature body?
body = {stmts_}
signature = (params) | (params) type | (params) (params)
params = ε | plist
plist = param | param ',' | param ',' plist
param = type | NAME type | '...' type | NAME '...' type
type = NAME targs? | NAME '.' NAME targs? | '*' type | [none] type | [expr] type | ['...'] type | 'map' [type] type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' signature | 'struct' {fields_} | 'interface' {methods_} | (type)
'...' = '...'
none = ε
targs = [types]
types = type | type ',' | type ',' types
fields_ = field*
field = names type tag? end | embedded tag? end
embedded = '*'? NAME targs? | '*'? NAME '.' NAME targs?
tag = 'STR'
end = ';' | EOS
methods_ = method*
method = NAME signature end | constraint end
stmts_ = stmtend*
stmtend = ';' | stmt ';' | laststmt EOS
laststmt = stmt
stmt = decl | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | {stmts_} | if | switch | 'select' {comms_} | 'for' fortail | NAME ':' stmt | NAME ':'
simple = exprs | exprs aop exprs | names ':=' exprs | expr '++' | expr '--' | expr '<-' expr
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if = 'if' expr {stmts_} else? | 'if' simple? ';' expr {stmts_} else?
else = 'else' if | 'else' {stmts_}
fortail = {stmts_} | expr {stmts_} | simple? ';' expr? ';' simple? {stmts_} | exprs '=' 'range' expr {stmts_} | names ':=' 'range' expr {stmts_} | 'range' expr {stmts_}
switch = 'switch' {cases} | 'switch' expr {cases} | 'switch' simple? ';' expr? {cases} | 'switch' tswitch {tcases} | 'switch' simple ';' tswitch {tcases}
tswitch = expr '.' (typeword) | NAME ':=' expr '.' (typeword)
typeword = 'type'
cases = case*
case = 'case' exprs ':' stmts_ | 'default' ':' stmts_
tcases = tcase*
tcase = 'case' ctypes ':' stmts_ | 'default' ':' stmts_
ctypes = type | type ',' ctypes
comms_ = comm*
comm = 'case' simple ':' stmts_ | 'default' ':' stmts_
exprs = expr | expr ',' exprs
expr = operand binary*
binary = binop operand
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '&^'
operand = unary operand | prim post*
unary = '+' | '-' | '!' | '^' | '*' | '&' | '<-'
prim = NAME | 'NUM' | 'STR' | 'CHR' | (expr) | (type) | ltype {lit} | 'func' signature {stmts_} | [none] type | 'map' [type] type | 'chan' type | 'struct' {fields_} | 'interface' {methods_}
ltype = NAME targs? | NAME '.' NAME targs? | [none] type | [expr] type | ['...'] type | 'map' [type] type | 'struct' {fields_}
lit = ε | litlist
litlist = elem | elem ',' | elem ',' litlist
elem = value | value ':' value
value = expr | {lit}
post = '.' NAME | '.' (type) | (args) | [index]
index = expr | types | expr? ':' expr? | expr? ':' expr ':' expr
args = ε | arglist
arglist = arg | arg ',' | arg ',' arglist
arg = expr '...'? | type
""".replace("['...']", "[dots]").replace("'...' = '...'", "dots = '...'")

C_WORDS = set("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local".split())
C_SOFT = {"__attribute__", "asm", "__asm__", "__extension__", "typeof", "__typeof__", "__inline", "__restrict"}
C = """
externals_ = external*
gnuitems_ = gnuitem*
gnuitem = external | 'asm' (any) ';' | NAME (args)
external = function | decl | ';' | '_Static_assert' (args) ';'
function = spec+ declarator attr* {stmts_} | spec+ declarator decl+ {stmts_}
decl = spec+ ';' | spec+ inits ';'
inits = init | init ',' inits
init = declarator attr* | declarator attr* '=' value
attr = '__attribute__' (any) | 'asm' (any) | '__asm__' (any)
value = asg | {values}
values = ε | valuelist
valuelist = elem | elem ',' | elem ',' valuelist
elem = value | designator+ '=' value | NAME ':' value
designator = '.' NAME | [asg]
spec = 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | 'const' | 'volatile' | 'restrict' | 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Noreturn' | '_Thread_local' | '_Atomic' | '_Alignas' (any) | attr | '__extension__' | '__inline' | '__restrict' | NAME | struct | enum | 'typeof' (any) | '__typeof__' (any)
struct = sword attr* NAME? {fields_} attr* | sword attr* NAME
sword = 'struct' | 'union'
fields_ = field*
field = spec+ fdecls? ';' | ';' | '_Static_assert' (args) ';'
fdecls = fdecl | fdecl ',' fdecls
fdecl = declarator attr* | declarator? ':' cond attr*
enum = 'enum' NAME? {enums} | 'enum' NAME
enums = enumlist
enumlist = enumer | enumer ',' | enumer ',' enumlist
enumer = NAME | NAME '=' cond
declarator = pointer* direct
pointer = '*' | 'const' | 'volatile' | 'restrict' | '__restrict' | attr
direct = NAME dsuffix* | (declarator) dsuffix*
dsuffix = (params) | [array]
array = ε | 'static'? asg | '*' | 'const' asg?
params = ε | plist | plist ',' '...' | names
names = NAME | NAME ',' names
plist = param | param ',' plist
param = spec+ | spec+ declarator attr* | spec+ abstract
abstract = pointer+ | pointer* adirect
adirect = (abstract) dsuffix* | dsuffix+
typename = spec+ | spec+ abstract
any = ε | token any
token = ANY | (any) | [any] | {any}
stmts_ = item*
item = decl | stmt
stmt = {stmts_} | ';' | expr ';' | 'if' (expr) stmt | 'if' (expr) stmt 'else' stmt | 'while' (expr) stmt | 'do' stmt 'while' (expr) ';' | 'for' (for) stmt | 'switch' (expr) stmt | 'case' cond ':' stmt | 'case' cond '...' cond ':' stmt | 'default' ':' stmt | NAME ':' stmt | NAME ':' decl | 'return' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' NAME ';' | 'asm' 'volatile'? (any) ';' | '__asm__' 'volatile'? (any) ';'
for = expr? ';' expr? ';' expr? | decl expr? ';' expr?
expr = asg | asg ',' expr
asg = cond | operand aop asg
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
cond = or | or '?' expr? ':' cond
or = operand binary*
binary = binop operand
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>'
operand = unary operand | (typename) operand | 'sizeof' (typename) | 'sizeof' operand | '_Alignof' (typename) | prim post*
unary = '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | '__extension__' | '&&'
prim = NAME | 'NUM' | strings | 'CHR' | (expr) | (typename) {values} | (gnublock) | '_Generic' (any)
gnublock = {stmts_}
strings = 'STR' | 'STR' strings | 'STR' NAME strings | 'STR' NAME | NAME strings
post = '.' NAME | '->' NAME | (args) | [expr] | '++' | '--'
args = ε | arglist
arglist = arg | arg ',' arglist
arg = asg | typename
"""

JSON = """
text = value
value = 'STR' | 'NUM' | 'true' | 'false' | 'null' | {members} | [elements]
members = ε | memberlist
memberlist = member | member ',' memberlist
member = 'STR' ':' value
elements = ε | elementlist
elementlist = value | value ',' elementlist
"""

YAML = """
stream = document | separated
separated = document? more+
more = '---' document? '...'?
document = node
node = map | seq | scalar
map = entry+
entry = 'KV' »folded«? | 'KV' {flow} | 'KV' [flowlist] | 'KEY' | 'KEY' »node« | 'KEY' seq | '?' »node«? | ':' »node«?
seq = item+
item = '-' | '-' »node«
scalar = 'SC' folded | {flow} | [flowlist]
folded = 'SC'*
flow = ε | pairs
pairs = pair | pair ',' | pair ',' pairs
pair = fnode | fnode ':' fnode? | '?' fnode ':' fnode?
flowlist = ε | items
items = pair | pair ',' | pair ',' items
fnode = 'SC' | {flow} | [flowlist]
"""
