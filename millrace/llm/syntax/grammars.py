"""Dialect grammars. Written for recognition: operators of all ranks share one rule, as rank does not decide validity."""

from __future__ import annotations

from functools import lru_cache

from .gll import Grammar

PYTHON = r"""
file = ( NEWLINE | stmt )*
stmt = simples | compound
simples = simple ( ';' simple )* [ ';' ] NEWLINE
block = simples | NEWLINE INDENT stmt+ DEDENT
simple = assign | 'pass' | 'break' | 'continue' | 'return' [ exprs ] | 'raise' [ test [ 'from' test ] ] | 'del' targets | 'assert' test [ ',' test ]
simple = ( 'global' | 'nonlocal' ) name ( ',' name )* | 'import' dotted [ 'as' name ] ( ',' dotted [ 'as' name ] )*
simple = 'from' ( ( '.' | '...' )* dotted | ( '.' | '...' )+ ) 'import' ( '*' | aliases | '(' aliases [ ',' ] ')' ) | 'type' name [ tparams ] '=' test
aliases = name [ 'as' name ] ( ',' name [ 'as' name ] )*
dotted = name ( '.' name )*
name = NAME
assign = exprs ( ( '=' ( exprs | yield ) )* | augop ( exprs | yield ) | ':' test [ '=' ( exprs | yield ) ] ) | yield
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
compound = 'if' named ':' block ( 'elif' named ':' block )* [ 'else' ':' block ] | 'while' named ':' block [ 'else' ':' block ] | for | with | def | class
compound = 'try' ':' block ( ( 'except' [ '*' ] [ exprs [ 'as' name ] ] ':' block )+ [ 'else' ':' block ] [ 'finally' ':' block ] | 'finally' ':' block )
compound = 'async' ( for | with | def ) | ( '@' named NEWLINE )+ ( def | 'async' def | class ) | match
for = 'for' targets 'in' exprs ':' block [ 'else' ':' block ]
with = 'with' ( item ( ',' item )* | '(' item ( ',' item )* [ ',' ] ')' ) ':' block
item = test [ 'as' target ]
def = 'def' name [ tparams ] '(' [ params ] ')' [ '->' test ] ':' block
class = 'class' name [ tparams ] [ '(' [ args ] ')' ] ':' block
tparams = '[' tparam ( ',' tparam )* [ ',' ] ']'
tparam = [ '*' | '**' ] name [ ':' test ] [ '=' test ]
params = param ( ',' param )* [ ',' ]
param = name [ ':' test ] [ '=' test ] | '*' [ name [ ':' ( test | '*' operand ) ] ] | '**' name [ ':' test ] | '/'
lparams = lparam ( ',' lparam )* [ ',' ]
lparam = name [ '=' test ] | '*' [ name ] | '**' name | '/'
match = 'match' exprs ':' NEWLINE INDENT ( 'case' patterns [ 'if' named ] ':' block )+ DEDENT
patterns = pattern ( ',' pattern )* [ ',' ]
pattern = [ '*' ] orpat [ 'as' name ]
orpat = closed ( '|' closed )*
closed = [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | strings | 'None' | 'True' | 'False' | dotted [ '(' [ argpat ( ',' argpat )* [ ',' ] ] ')' ] | '(' [ patterns ] ')' | '[' [ patterns ] ']'
closed = '{' [ mappat ( ',' mappat )* [ ',' ] ] '}'
argpat = [ name '=' ] pattern
mappat = closed ':' pattern | '**' name
targets = target ( ',' target )* [ ',' ]
target = [ '*' ] primary
yield = 'yield' [ exprs | 'from' test ]
exprs = starred ( ',' starred )* [ ',' ]
starred = named | '*' operands
named = test [ ':=' test ]
test = operands [ 'if' operands 'else' test ] | lambda
lambda = 'lambda' [ lparams ] ':' test
operands = operand ( binop operand )*
operand = ( '-' | '+' | '~' | 'not' )* [ 'await' ] primary
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or'
primary = atom ( '.' name | '(' [ args ] ')' | '[' subs ']' )*
atom = name | NUMBER | strings | '...' | 'None' | 'True' | 'False' | '(' [ yield | starred ( comp | ( ',' starred )* [ ',' ] ) ] ')' | '[' [ starred ( comp | ( ',' starred )* [ ',' ] ) ] ']'
atom = '{' [ entry ( comp | ( ',' entry )* [ ',' ] ) ] '}' | '{' starred ( comp | ( ',' starred )* [ ',' ] ) '}'
entry = test ':' test | '**' operands
strings = ( STRING | fstring )+
fstring = FSTRING_START fpart* FSTRING_END
fpart = FSTRING_MIDDLE | '{' ( exprs | yield ) [ '=' ] [ '!' name ] [ ':' fpart* ] '}'
comp = ( [ 'async' ] 'for' targets 'in' operands ( 'if' condition )* )+
condition = operands [ ':=' test ] | lambda
args = arg ( ',' arg )* [ ',' ]
arg = named [ comp ] | name '=' test | '*' test | '**' test
subs = sub ( ',' sub )* [ ',' ]
sub = starred | [ test ] ':' [ test ] [ ':' [ test ] ]
"""

# ~ is replaced by nothing and by A: the same rules outside and inside async functions, where await is an operator.
# $ is replaced by nothing, S and L: the same statements outside, in a switch, and in a loop, for break and continue.
JAVASCRIPT = r"""
stmt~$ = block~$ | decl~ semi | ';' | @expr expr~ semi | 'if' '(' expr~ ')' stmt~$ [ 'else' stmt~$ ] | 'do' stmt~L 'while' '(' expr~ ')' [ ';' ] | 'while' '(' expr~ ')' stmt~L
stmt~$ = 'for' '(' [ expr~ | decl~ ] ';' [ expr~ ] ';' [ expr~ ] ')' stmt~L | 'for' '(' ( ( 'var' | 'let' | 'const' ) bind~ | target~ | pattern~ ) ( 'of' assign~ | 'in' expr~ ) ')' stmt~L
stmt~$ = 'return' [ expr~ ] semi | 'with' '(' expr~ ')' stmt~$ | 'throw' expr~ semi | 'debugger' semi | name ':' stmt~$ | 'break' name semi
stmt~$ = 'try' block~$ ( 'catch' [ '(' bind~ ')' ] block~$ [ 'finally' block~$ ] | 'finally' block~$ )
stmt~$ = function~ | class~
stmt~ = 'switch' '(' expr~ ')' '{' ( ( 'case' expr~ | 'default' ) ':' stmt~S* )* '}'
stmt~S = 'switch' '(' expr~ ')' '{' ( ( 'case' expr~ | 'default' ) ':' stmt~S* )* '}' | 'break' semi
stmt~L = 'switch' '(' expr~ ')' '{' ( ( 'case' expr~ | 'default' ) ':' stmt~L* )* '}' | 'break' semi | 'continue' [ name ] semi
semi = ';' | @asi
block~$ = '{' stmt~$* '}'
decl~ = ( 'var' | 'let' | 'const' ) bind~ [ '=' assign~ ] ( ',' bind~ [ '=' assign~ ] )*
bind~ = name | '{' [ prop~ ( ',' prop~ )* [ ',' ] ] '}' | '[' ','* [ [ '...' ] bind~ [ '=' assign~ ] ( ','+ [ '...' ] bind~ [ '=' assign~ ] )* ','* ] ']'
prop~ = key~ ':' bind~ [ '=' assign~ ] | name [ '=' assign~ ] | '...' bind~
function~ = 'function' [ '*' ] [ name ] '(' [ params ] ')' block | 'async' 'function' [ '*' ] [ name ] '(' [ paramsA ] ')' blockA
params~ = param~ ( ',' param~ )* [ ',' ]
param~ = [ '...' ] bind~ [ '=' assign~ ]
class~ = 'class' [ name ] [ 'extends' postfix~ ] '{' member~* '}'
member~ = ';' | [ 'static' ] ( key~ | PRIVATE ) [ '=' assign ] semi | [ 'static' ] method~ | 'static' block
method~ = [ 'get' | 'set' | '*' ] ( key~ | PRIVATE ) '(' [ params ] ')' block | 'async' [ '*' ] ( key~ | PRIVATE ) '(' [ paramsA ] ')' blockA
key~ = WORD | STRING | NUMBER | '[' assign~ ']'
expr~ = assign~ ( ',' assign~ )*
assign~ = operands~ [ '?' assign~ ':' assign~ ] | target~ ( '=' | augop ) assign~ | pattern~ '=' assign~ | arrow~ | 'yield' [ [ '*' ] assign~ ]
operands~ = unit~ ( binop unit~ )*
unit~ = prefix~* ( postfix~ | target~ ( '++' | '--' ) | ( '++' | '--' ) target~ )
binop = '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>>' | '>>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
augop = '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
prefix~ = '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'new'
prefixA = 'await'
target~ = name | '(' target~ ')' | 'new'* primary~ suffix~* ( '.' ( WORD | PRIVATE ) | '[' expr~ ']' )
pattern~ = '{' [ slot~ ( ',' slot~ )* [ ',' ] ] '}' | '[' ','* [ [ '...' ] place~ [ '=' assign~ ] ( ','+ [ '...' ] place~ [ '=' assign~ ] )* ','* ] ']'
slot~ = key~ ':' place~ [ '=' assign~ ] | name [ '=' assign~ ] | '...' place~
place~ = target~ | pattern~
arrow~ = name '=>' body | '(' [ params~ ] ')' '=>' body | 'async' name '=>' bodyA | 'async' '(' [ paramsA ] ')' '=>' bodyA
body~ = block~ | @expr assign~
postfix~ = primary~ suffix~*
suffix~ = '.' ( WORD | PRIVATE ) | '?.' ( WORD | PRIVATE | '[' expr~ ']' | callargs~ ) | '[' expr~ ']' | callargs~ | template~
callargs~ = '(' [ [ '...' ] assign~ ( ',' [ '...' ] assign~ )* [ ',' ] ] ')'
primary~ = name | NUMBER | STRING | REGEX | template~ | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr~ ')' | function~ | class~
primary~ = '[' ','* [ [ '...' ] assign~ ( ','+ [ '...' ] assign~ )* ','* ] ']' | '{' [ entry~ ( ',' entry~ )* [ ',' ] ] '}' | 'import' callargs~ | 'new' '.' 'target' | PRIVATE 'in' unit~
entry~ = key~ ':' assign~ | name | '...' assign~ | method~
template~ = TEMPLATE | TEMPLATE_HEAD expr~ ( TEMPLATE_MIDDLE expr~ )* TEMPLATE_TAIL
name = NAME
"""

C_SHARED = r"""
unit = external*
external = declaration | specs declarator declaration* body | ';' | asm ';'
body = attrs block
declaration = specs [ init ( ',' init )* ] ';' | '_Static_assert' '(' cond [ ',' STRING ] ')' ';' | '__extension__' declaration
init = declarator [ asm ] attrs [ '=' value ]
value = assign | '{' [ designated ( ',' designated )* [ ',' ] ] '}'
designated = [ ( '[' cond [ '...' cond ] ']' | '.' NAME )+ '=' | NAME ':' ] value
attrs = ( '__attribute__' '(' '(' balanced* ')' ')' )*
balanced = NAME | NUMBER | STRING | CHAR | ',' | '=' | 'const' | 'int' | 'char' | 'void' | '*' | '+' | '-' | '.' | '&' | 'sizeof' | '(' balanced* ')'
asm = 'asm' [ 'volatile' ] [ 'goto' ] '(' asmpart* ')'
asmpart = NAME | NUMBER | STRING | ',' | ':' | '[' NAME ']' | '(' expr ')' | '(' ')'
qual = 'const' | 'volatile' | 'restrict' | '_Atomic' | '__attribute__' '(' '(' balanced* ')' ')' | '__extension__'
storage = 'static' | 'extern' | 'typedef' | 'register' | 'auto' | 'inline' | '_Noreturn' | '_Thread_local' | '_Alignas' '(' ( typename | cond ) ')'
builtin = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | '_Imaginary'
named = NAME | struct | enum | 'typeof' '(' ( expr | typename ) ')' | '_Atomic' '(' typename ')'
specs = ( storage | qual )* ( named ( storage | qual )* | builtin ( builtin | storage | qual )* )
struct = ( 'struct' | 'union' ) attrs ( NAME | [ NAME ] '{' field* '}' attrs )
field = squals [ fdecl ( ',' fdecl )* ] ';' | ';' | '_Static_assert' '(' cond [ ',' STRING ] ')' ';'
squals = qual* ( named qual* | builtin ( builtin | qual )* )
fdecl = ( declarator [ ':' cond ] | ':' cond ) attrs
enum = 'enum' attrs ( NAME | [ NAME ] '{' enumerator ( ',' enumerator )* [ ',' ] '}' attrs )
enumerator = NAME attrs [ '=' cond ]
declarator = ( '*' qual* )* direct
direct = ( NAME | '(' attrs declarator ')' ) suffix*
suffix = '[' ( 'static' | qual )* [ assign | '*' ] ']' | '(' [ parameters ] ')'
parameters = parameter ( ',' parameter )* [ ',' '...' ] | '...'
parameter = specs [ declarator | abstract ] attrs
abstract = ( '*' qual* )+ [ adirect ] | adirect
adirect = '(' abstract ')' suffix* | suffix+
typename = squals [ abstract ]
block = '{' ( declaration | stmt | labels )* '}'
labels = '__label__' NAME ';'
stmt = block | [ expr ] ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'switch' '(' expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
stmt = 'for' '(' ( [ expr ] ';' | declaration ) [ expr ] ';' [ expr ] ')' stmt | 'goto' ( NAME | '*' expr ) ';' | 'continue' ';' | 'break' ';' | 'return' [ expr ] ';'
stmt = NAME ':' attrs ( stmt | declaration | @asi ) | 'case' cond [ '...' cond ] ':' ( stmt | declaration | @asi ) | 'default' ':' ( stmt | declaration | @asi ) | asm ';'
expr = assign ( ',' assign )*
assign = operands [ '?' [ expr ] ':' assign ]
cond = assign
operands = operand ( binop operand )*
binop = '+' | '-' | '*' | '/' | '%' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>>=' | '&=' | '|=' | '^='
operand = ( '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | '__extension__' | '&&' )* ( postfix | '(' typename ')' operand | 'sizeof' ( operand | '(' typename ')' ) | '_Alignof' '(' typename ')' )
postfix = primary ( '[' expr ']' | '(' [ callarg ( ',' callarg )* ] ')' | '.' NAME | '->' NAME | '++' | '--' )*
callarg = assign | typename
primary = NAME | NUMBER | CHAR | STRING+ | '(' expr ')' | '(' block ')' | '(' typename ')' '{' [ designated ( ',' designated )* [ ',' ] ] '}' | '_Generic' '(' assign ( ',' ( typename | 'default' ) ':' assign )+ ')'
"""

# the older dialect: functions without a type, and parameters declared after the list
C_OLD = r"""
oldunit = ( external | declarator declaration* body )*
suffix = '(' NAME ( ',' NAME )* ')'
"""


@lru_cache(None)
def grammar(language: str) -> Grammar:
    """The grammar of a language with all its dialects as start rules, run together."""
    if language == "python":
        return Grammar(PYTHON, ["file"])
    if language == "javascript":
        rules = []
        for line in JAVASCRIPT.strip().splitlines():
            line = line.replace("'~'", "\0")
            for x in ("", "A") if "~" in line else ("",):
                rules += [line.replace("~", x).replace("$", y).replace("\0", "'~'") for y in (("", "S", "L") if "$" in line else ("",))]
        return Grammar("\n".join(["script = stmt*", *rules]), ["script"])
    return Grammar(C_SHARED + C_OLD, ["unit", "oldunit"])
