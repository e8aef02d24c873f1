"""Token grammars of the file types that the syntax check knows, for :mod:`derivatives`.

They are written from the public language references. Where a rule depends on more than the tokens (assignment
targets, repeated keys), the grammar is wider and an exact check follows.
"""

from __future__ import annotations

JSON = """
text = value
value = 's' | '0' | 'w' | '{' ( pair ( ',' pair )* )? '}' | '[' ( value ( ',' value )* )? ']'
pair = 's' ':' value
"""

TOML = """
text = line*
line = 'NL' | key '=' value 'NL' | '[' key ']' 'NL' | '[[' key ']]' 'NL'
key = part ( '.' part )*
part = 'k' | 's'
value = 's' | 'S' | '0' | '[' skip ( value skip ( ',' skip value skip )* ( ',' skip )? )? ']' | '{' ( key '=' value ( ',' key '=' value )* )? '}'
skip = 'NL'*
"""

YAML = """
text = '...'* ( document? ( '---' document? '...'* )* )
document = node | inline_only
inline_only = props? flow 'NL' more?
node = map | seq
map = ( 'K' after )+
seq = ( '-' item )+
after = props? ( flow 'NL' more? | '|' 'NL' | 'NL' ( 'I' ( node | inline_only ) 'D' | seq )? ) | props 'I' node 'D'
item = props? ( flow 'NL' more? | '|' 'NL' | 'NL' ( 'I' ( node | inline_only ) 'D' )? | 'I' node 'D' )
more = 'I' ( 'v' 'NL' )+ 'D' | ( 'v' 'NL' )
props = 'p'+
flow = 'v' | '*' | 'q' | '{' ( entry ( ',' entry )* ','? )? '}' | '[' ( entry ( ',' entry )* ','? )? ']'
entry = props? flow ( ':' ( props? flow )? )? | ':' ( props? flow )? | props
"""

PYTHON = """
file = 'NL'* ( stmt 'NL'* )*
stmt = simple | compound
block = simple | 'NL' 'I' 'NL'* ( stmt 'NL'* )+ 'D'
simple = small ( ';' small )* ';'? 'NL'
small = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( expr ( 'from' expr )? )? | ( 'global' | 'nonlocal' ) name ( ',' name )* | 'del' exprs | 'assert' expr ( ',' expr )? | import | assign | typealias
typealias = 'type' name params? '=' expr
import = 'import' dotted ( 'as' name )? ( ',' dotted ( 'as' name )? )* | 'from' ( dots dotted? | dotted ) 'import' ( '*' | names | '(' names ','? ')' )
dots = ( '.' | '...' )+
names = name ( 'as' name )? ( ',' name ( 'as' name )? )*
dotted = name ( '.' name )*
name = 'n' | 'match' | 'case' | 'type' | '_'
assign = exprs ( ( '=' ( exprs | yield ) )+ | 'op=' ( exprs | yield ) | ':' expr ( '=' ( exprs | yield ) )? )? | yield ( '=' ( exprs | yield ) )*
yield = 'yield' ( 'from' expr | exprs )?
exprs = starred ( ',' starred )* ','?
starred = '*' bitor | named
named = expr ( ':=' expr )?
expr = or ( 'if' or 'else' expr )? | lambda
lambda = 'lambda' ( larg ( ',' larg )* ','? )? ':' expr
larg = name ( '=' expr )? | '*' name? | '**' name | '/'
or = and ( 'or' and )*
and = not ( 'and' not )*
not = 'not'* compare
compare = bitor ( ( '<' | '==' | 'in' | 'not' 'in' | 'is' 'not'? ) bitor )*
bitor = unary ( ( '|' | '+' | '*' | '**' | '/' | '@' ) unary )*
unary = ( '+' | '~' )* 'await'? primary
primary = atom ( '.' name | '(' args? ')' | '[' slices ']' )*
atom = name | '0' | 's'+ | 'const' | '...' | '(' ( yield | inside )? ')' | '[' inside? ']' | '{' braces? '}'
inside = starred ( for+ | ( ',' starred )* ','? )
braces = dictitem ( for+ | ( ',' dictitem )* ','? ) | inside
dictitem = expr ':' expr | '**' bitor
for = 'async'? 'for' targets 'in' or ( 'if' condition )* | 'async'? 'for' targets 'in' or 'if' or 'else' expr
condition = or ( ':=' expr )? | lambda
targets = ( '*'? bitor ) ( ',' '*'? bitor )* ','?
args = arg ( ',' arg )* ','?
arg = named for* | name '=' expr | '*' expr | '**' expr
slices = slice ( ',' slice )* ','?
slice = named | expr? ':' expr? ( ':' expr? )? | '*' bitor
compound = if | while | for_stmt | try | with | def | class | decorated | match | 'async' ( def | with | for_stmt )
decorated = ( '@' named 'NL' )+ ( def | class | 'async' def )
if = 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )?
while = 'while' named ':' block ( 'else' ':' block )?
for_stmt = 'for' targets 'in' exprs ':' block ( 'else' ':' block )?
try = 'try' ':' block ( ( 'except' '*'? ( exprs ( 'as' name )? )? ':' block )+ ( 'else' ':' block )? ( 'finally' ':' block )? | 'finally' ':' block )
with = 'with' ( withitem ( ',' withitem )* | '(' withitem ( ',' withitem )* ','? ')' ) ':' block
withitem = expr ( 'as' target )?
target = '*'? bitor
def = 'def' name params? '(' ( parameter ( ',' parameter )* ','? )? ')' ( '->' expr )? ':' block
parameter = name ( ':' ( expr | '*' bitor ) )? ( '=' expr )? | '*' ( name ( ':' ( expr | '*' bitor ) )? )? | '**' name ( ':' expr )? | '/'
params = '[' param ( ',' param )* ','? ']'
param = '*'? name ( ':' expr )? ( '=' expr )? | '**' name ( '=' expr )?
class = 'class' name params? ( '(' args? ')' )? ':' block
match = 'match' exprs ':' 'NL' 'I' ( 'case' pattern ( 'if' named )? ':' block )+ 'D'
pattern = aspat ( ',' aspat )* ','?
aspat = '*' name | orpat ( 'as' name )?
orpat = pat ( '|' pat )*
pat = ( '+' )? '0' ( '+' '0' )? | 's'+ | 'const' | dotted ( '(' ( parg ( ',' parg )* ','? )? ')' )? | '(' pattern? ')' | '[' pattern? ']' | '{' ( mpat ( ',' mpat )* ','? )? '}'
parg = aspat | name '=' aspat
mpat = ( ( '+' )? '0' | 's'+ | 'const' | dotted ) ':' aspat | '**' name
"""

JS = """
module = item*
item = import | export | stmt | decl
import = 'import' ( 's' | clause 'from' 's' ) with? ';'
with = 'with' '{' ( ( id | 's' ) ':' 's' ( ',' ( id | 's' ) ':' 's' )* ','? )? '}'
clause = id ( ',' ( '*' 'as' id | nameds ) )? | '*' 'as' id | nameds
nameds = '{' ( spec ( ',' spec )* ','? )? '}'
spec = ( word | 's' ) ( 'as' ( word | 's' ) )?
export = 'export' ( '*' ( 'as' ( word | 's' ) )? 'from' 's' with? ';' | nameds ( 'from' 's' with? )? ';' | decl | 'var' vars ';' | 'default' ( func | class | !{'function' 'class'} assign ';' ) )
decl = named_func | named_class | 'const' vars ';' | 'let' vars ';'
named_func = 'async'? 'function' '*'? id '(' params? ')' '{' body '}'
named_class = 'class' id ( 'extends' unary_left )? '{' member* '}'
func = 'async'? 'function' '*'? id? '(' params? ')' '{' body '}'
class = 'class' id? ( 'extends' unary_left )? '{' member* '}'
member = ';' | 'static'? ( method | field ) | 'static' '{' body '}'
method = ( 'get' | 'set' | 'async'? '*'? ) prop '(' params? ')' '{' body '}'
field = prop ( '=' assign )? ';'
prop = word | 's' | '0' | '#' | '[' assign ']'
body = item*
params = param ( ',' param )* ','?
param = '...'? binding ( '=' assign )?
binding = id | '{' ( bprop ( ',' bprop )* ','? )? '}' | '[' ','* ( bel ( ','+ bel )* ','* )? ']'
bprop = '...' id | prop ( ':' binding )? ( '=' assign )?
bel = '...'? binding ( '=' assign )?
vars = var ( ',' var )*
var = binding ( '=' assign )?
block = '{' body '}'
stmt = block | ';' | 'var' vars ';' | if | for | while | 'do' stmt 'while' '(' expr ')' ';'? | jump | try | switch | throw | 'debugger' ';' | id ':' stmt | !{'{' 'function' 'class' 'let'} expr ';'
if = 'if' '(' expr ')' sub ( 'else' sub )?
sub = stmt
while = 'while' '(' expr ')' stmt
for = 'for' 'await'? '(' head ')' stmt
head = ( ( 'var' | 'let' | 'const' ) forvar | expr )? ( 'S' expr? 'S' expr? ) | ( 'var' | 'let' | 'const' ) binding ( 'of' assign | 'in' expr ) | unary_left ( 'of' assign | 'in' expr )
forvar = binding ( '=' assign )? ( ',' var )*
jump = 'return' expr? ';' | 'break' id? ';' | 'continue' id? ';'
throw = 'throw' expr ';'
try = 'try' block ( 'catch' ( '(' binding ')' )? block ( 'finally' block )? | 'finally' block )
switch = 'switch' '(' expr ')' '{' ( ( 'case' expr | 'default' ) ':' body )* '}'
expr = assign ( ',' assign )*
assign = cond ( ( '=' | 'op=' ) assign | '=>' arrow )? | 'yield' ( '*'? assign )? | '(' ')' '=>' arrow | 'async' id '=>' arrow
arrow = 'B' body '}' | !{'{'} assign
cond = binary ( '?' assign ':' assign )?
binary = unary ( ( 'bin' | '*' | '+' | '/' | 'in' ) unary )*
unary = ( '+' | '!' | 'typeof' | '++' | 'await' )* postfix
postfix = unary_left '++'?
unary_left = ( 'new'* ( primary | 'new' '.' word ) ) ( '.' ( word | '#' ) | '?.' ( word | '#' | '[' expr ']' | '(' args? ')' ) | '[' expr ']' | '(' args? ')' | template )*
args = arg ( ',' arg )* ','?
arg = '...'? assign
primary = id | 'this' | 'super' | '0' | 's' | 're' | 'const_value' | template | '(' group ')' | '[' ','* ( arg ( ','+ arg )* ','* )? ']' | '{' ( oprop ( ',' oprop )* ','? )? '}' | func | class | 'import' ( '(' args ')' | '.' word ) | '#'
group = expr ( ',' ( '...' binding )? )? | '...' binding
oprop = '...' assign | id ( '=' assign )? | prop ':' assign | method
template = 'T' | 'T{' expr ( '}T{' expr )* '}T'
id = 'n' | 'of' | 'get' | 'set' | 'static' | 'async' | 'from' | 'as'
word = id | 'kw' | 'import' | 'export' | 'default' | 'function' | 'class' | 'extends' | 'const' | 'let' | 'var' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'debugger' | 'new' | 'typeof' | 'in' | 'this' | 'super' | 'const_value' | 'yield' | 'await' | 'with' | 'bin_word'
"""
